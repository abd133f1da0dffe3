"""Training-data operators: deduplication, filters, archives and tokens.

Nothing else in the library imports this subpackage.
"""
