"""Operators for large text corpora: scoring, filtering, deduplication, mixing, sharding, archives and tokenizers."""
