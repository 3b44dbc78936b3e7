"""Operators that prepare text corpora: sharding, packing, de-duplication, tokens, search, quality."""
