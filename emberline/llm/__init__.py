"""Corpus operators for large-scale training data: sharding, dedup, mixing, scoring, packing."""
