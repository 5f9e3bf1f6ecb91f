"""Training-data operators: fingerprints, shards, extraction, tokens, quality, archives, near-duplicates, scores, mixes."""
