"""Relational and iterative clustering operators."""
