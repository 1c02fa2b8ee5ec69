"""Readers, inventories, samples."""
