"""Training-data operators: deduplication, filters, packing, search, tokenizing."""
