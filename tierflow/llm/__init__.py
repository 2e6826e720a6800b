"""Operators of a training-data pipeline: near-dedup, sharding, token output,
WARC, mixing, tokenising, quality rules and models, URL filters.

Nothing else in the package imports this subpackage.
"""
