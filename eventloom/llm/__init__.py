"""Operators for preparing training text: deduplication, language, sharding, mixing, filters, tokens."""
