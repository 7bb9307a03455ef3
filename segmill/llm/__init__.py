"""Operators that prepare training data: dedup, extraction, quality, mixing, tokens."""
