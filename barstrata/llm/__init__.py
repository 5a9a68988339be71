"""Training-data operators: dedup, filtering, mixing and packing of text corpora.

Nothing else in the library imports this subpackage.
"""
