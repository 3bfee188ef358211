"""Training-data operators: sharding, deduplication, filtering, encoding, search.

Nothing else in the library imports this subpackage.
"""
