"""Training-data operators: counting, filtering, deduplication, mixing, packing, output."""
