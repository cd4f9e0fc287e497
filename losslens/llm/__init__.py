"""Training-data operators: scoring, packing, tokenizing, filtering, near-duplicates.

Nothing else in the library imports this package.  Each module holds one
operator with a general interface; ``queries`` has the thin ``opN_`` queries.
"""
