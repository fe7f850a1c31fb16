"""Training-data operators: near-duplicates, joins, filters, tokenizing, packing and search."""
