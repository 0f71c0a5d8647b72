"""A PySpark-native engine for record linkage, catalog organizing and training-data preparation."""
