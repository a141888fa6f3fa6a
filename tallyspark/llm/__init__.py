"""Operators for training-data pipelines: mixing, near and exact dedup, tokenizing, scans, quality and search."""
