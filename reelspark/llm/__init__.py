"""Training-data operators: deduplication, quality, language, packing, scoring and scans over document tables."""
