"""Spark-native corpus curation: sources, text features, filters, dedup, mixing, packing, shards."""
