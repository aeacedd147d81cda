"""Operators of a training-data pipeline: formatting, deduplication, filtering, mixing, packing."""
