"""Operators for training-data corpora: packing, deduplication, quality, mixing, scanning, archives and URL filters."""
