"""Training-data operators: mixing, quality, tokenising, deduplication, scoring and extraction."""
