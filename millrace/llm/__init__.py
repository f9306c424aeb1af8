"""Training-data operators: sharding, filtering, deduplication, mixing and token output."""
