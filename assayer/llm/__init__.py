"""Training-data operators: near-duplicate search, tokenising, packing, filtering.

Nothing else in the library imports this subpackage.
"""
