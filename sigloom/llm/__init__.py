"""Training-data operators: scoring, packing, token files, near duplicates, sharding, archives, extraction and media."""
