"""Training-data operators for very large corpora: language id, packing, sharding, mixing, toxicity, record
fixity, audio features, top-k search, near-duplicate detection and token files.

Nothing else in the library imports this package; it can be deleted as a whole.
"""
