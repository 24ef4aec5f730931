"""Operators for training data: quality, toxicity, tokens, packing, near-duplicates, archives, secrets."""
