"""Operators for large text corpora: tokens, language, toxicity, duplicates, shards and packed sequences."""
