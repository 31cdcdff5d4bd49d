"""Training-data operators: quality, sharding, decontamination, extraction, dedup, packing, fingerprints."""
