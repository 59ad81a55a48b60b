"""Operators for building training corpora; queries over the given tables are in ``queries``."""
