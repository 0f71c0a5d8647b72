"""Linkage, canonical folders, layouts, move and merge plans."""
