"""Registered query plans over the synthetic tables."""
