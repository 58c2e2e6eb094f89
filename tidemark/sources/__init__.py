"""Readers of feeds, in batch and as streams."""
