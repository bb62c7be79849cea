"""Training-data operators: filters, near-duplicate joins, packing, extraction."""
