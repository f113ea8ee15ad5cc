"""DataFrame operators: filters, dedup, mixing, packing, windows, shards, evaluation."""
