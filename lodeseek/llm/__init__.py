"""Training-data operators: search, scoring, deduplication, packing, files."""
