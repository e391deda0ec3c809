"""Training-data operators: scoring, deduplication, sharding, packing and archives of a text corpus."""
