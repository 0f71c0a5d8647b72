"""Column expressions: text normalization, paths and similarity. No Python runs on executors."""
