"""Training-data operators: deduplication, filtering, packing, archives, search and tokens."""
