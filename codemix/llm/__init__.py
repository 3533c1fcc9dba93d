"""Operators of a training-data pipeline: language, duplicates, extraction, mixing, packing, search."""
