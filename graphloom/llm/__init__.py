"""Training-data operators: deduplication, filtering, tokenising, archives.

Nothing else in the library imports this subpackage; it may import the rest.
"""
