"""Training-data operators: scoring, near-duplicates, extraction, packing, sharding, search."""
