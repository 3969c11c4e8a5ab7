"""Operators over training-data corpora; nothing outside this package imports it."""
