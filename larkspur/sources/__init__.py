"""Sources: playlist tables, directory trees, audio tags."""
