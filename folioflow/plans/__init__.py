"""Whole queries, and the helpers that shape their plans."""
