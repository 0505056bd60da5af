"""Operators for building training data out of a large corpus."""
