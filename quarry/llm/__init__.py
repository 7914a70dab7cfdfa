"""Training-data operators: dedup, quality, decontamination, mixing, sharding."""
