"""Training-data operators: quality rules, deduplication, joins, tokenization, scans, packing."""
