"""Operators that prepare training text: deduplication, filtering, extraction, mixing, packing."""
