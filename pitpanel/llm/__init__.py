"""Training-data operators: quality, privacy, token counts, deduplication, archives and packing."""
