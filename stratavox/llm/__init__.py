"""Training-data operators: quality, dedup, search, language, packing, PII, tokenising and HTML extraction."""
