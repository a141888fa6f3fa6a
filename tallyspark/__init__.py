"""Typed DataFrame operators, data-quality gates and named queries for public-records data."""
