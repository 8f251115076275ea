"""Operators for preparing text corpora: filtering, deduplication, mixing, sharding, encoding."""
