"""Training-data operators: search, fingerprints, token counts, mixing, sharding, quality, licences, packing, near-dedup, URL filters,
token files, ranked search, whitening.

Nothing else in the library imports this subpackage.  Each module holds one operator with its own general interface; ``queries`` holds
the thin ``opN_<name>`` queries that apply them to whole tables.
"""
