"""Operators for preparing training data: duplicates, quality, language, secrets, mixing, tokens."""
