"""Playlists that arrive over time: each micro-batch is matched like a table."""
