"""Training-data operators: text scoring, filtering, deduplication, packing.

Each module holds one operator with its own general interface; ``queries``
registers the thin contract queries (``op1_`` ... ``op13_``). Nothing else in
the library imports this package.
"""
