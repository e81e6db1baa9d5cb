"""Readers and writers of point tables."""
