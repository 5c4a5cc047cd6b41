"""Training-data operators: tokenizing, deduplication, search, packing, formatting, archives, sharding."""
