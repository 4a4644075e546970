"""Operators for preparing training data: sharding, dedup, mixing, filtering, search and packing.

Nothing else in the library imports this subpackage.
"""
