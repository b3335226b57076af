"""Operators for large training corpora: scanning, sharding, language ID, sketches, near-duplicates, mixing, tokens."""
