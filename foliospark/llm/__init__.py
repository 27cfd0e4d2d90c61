"""Operators of a training-data pipeline: extraction, filtering, deduplication, mixing and sharding.

Nothing outside this package imports it.
"""
