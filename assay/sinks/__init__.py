"""Stored runs and audit logs."""
