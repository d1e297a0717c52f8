"""Operators that prepare training data: archives, scans, deduplication, quality, tokens.

Nothing else in the library imports this package."""
