"""Training-data operators: packing, near-dedup, language id, media columns, token counts,
substring dedup, quality rules, mixing, line dedup and a quality classifier.

The subpackage is self-contained: nothing else in the library imports it.
"""
