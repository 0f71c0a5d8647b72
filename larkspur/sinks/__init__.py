"""Sinks: playlists, reports, and applying plans to a file system."""
