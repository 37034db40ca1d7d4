"""Readers of landed files and the panel views derived from the driver tables."""
