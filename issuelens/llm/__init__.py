"""Operators for building training data: de-duplication, filtering, search, mixing, sharding."""
