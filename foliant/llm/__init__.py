"""Training-data operators: search, tokenisation, scans, packing and deduplication."""
