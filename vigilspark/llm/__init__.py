"""Training-data operators: tokenising, near-duplicates, mixing, filters.

Nothing outside this subpackage imports it.
"""
