"""Training-data operators: filtering, deduplication, search, scanning and packing of large corpora.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
