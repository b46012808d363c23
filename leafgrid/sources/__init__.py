"""Readers, writers and views derived from the driver's tables."""
