"""Operators for preparing training text: quality, deduplication, mixing, packing, token files, scoring, sharding."""
