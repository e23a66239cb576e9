"""Training-data operators: deduplication, packing, search, mixing, media, quality and sharding."""
