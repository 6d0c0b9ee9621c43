"""Operators for preparing training text: filters, near-duplicates, scans, tokens."""
