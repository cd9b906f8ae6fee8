"""Training-data operators: language ID, deduplication, packing, archives, scoring.

Nothing else in the library imports this subpackage.
"""
