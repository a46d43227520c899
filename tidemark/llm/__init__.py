"""Operators for preparing training data: text, near-duplicates, vectors, tokens. Nothing outside imports this."""
