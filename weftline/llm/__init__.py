"""Training-data operators: tokenising, packing, deduplication, classification, media."""
