"""Training-data operators: deduplication, archives, privacy, tokens, mixing, sharding, toxicity."""
