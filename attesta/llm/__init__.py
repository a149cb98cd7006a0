"""Operators for preparing training data: deduplication, filters, scoring, packing, encoding."""
