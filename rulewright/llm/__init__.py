"""Operators for preparing training text: near-duplicates, filters, packing, formatting."""
