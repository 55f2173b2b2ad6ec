"""Training-data operators: tokenising, deduplication, filtering, extraction.

Nothing outside this subpackage imports it.
"""
