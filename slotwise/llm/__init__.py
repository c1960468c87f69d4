"""Training-data operators: sharding, deduplication, archives, PII, search, mixing, fingerprints, BPE, toxicity."""
