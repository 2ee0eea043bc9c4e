"""Training-data operators: scoring, search, deduplication, tokenising, packing and filtering.

Nothing else in the library imports this subpackage.
"""
