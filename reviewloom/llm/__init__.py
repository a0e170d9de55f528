"""Training-data operators: tokenization, packing, dedup, filtering and search."""
