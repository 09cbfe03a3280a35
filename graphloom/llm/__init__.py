"""Training-data operators (near-duplicates, extraction, filters, sharding, tokenising)."""
