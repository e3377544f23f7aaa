"""Operators for training-data pipelines: quality, near-duplicates, personal
data, mixing, packing, chat formatting, language and embeddings.

Nothing else in the library imports this subpackage.
"""
