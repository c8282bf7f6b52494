"""Operators for preparing training text: language, duplicates, contamination, quality, privacy, packing."""
