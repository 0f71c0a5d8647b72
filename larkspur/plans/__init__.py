"""Whole programs as plans, the registered queries and their SQL."""
