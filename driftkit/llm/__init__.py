"""Operators of a training-data pipeline: sharding, exact and approximate vector
search, source mixing, token counts, near-duplicate and substring removal,
toxicity and quality scores, sequence packing.  Nothing else in the library
imports this subpackage."""
