"""Training-data operators: quality, tokens, near-duplicates, archives, packing, filters.

Nothing else in the library imports this subpackage.
"""
