"""Operators for preparing training data: deduplication, filtering, mixing, packing and archives."""
