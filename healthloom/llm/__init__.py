"""Training-data operators: deduplication, language, mixing, privacy, packing, search, quality and licences."""
