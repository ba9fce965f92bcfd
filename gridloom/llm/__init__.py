"""Training-data operators: cleaning, deduplication, sketching, packing and sharding of text tables."""
