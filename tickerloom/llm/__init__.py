"""Operators for preparing training data: duplicates, extraction, language, quality, mixing, packing."""
