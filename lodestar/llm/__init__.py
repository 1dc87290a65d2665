"""Operators for large training-corpus preparation (dedup, filtering, mixing, tokenization)."""
