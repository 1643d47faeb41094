"""Bulk scoring of rows as they arrive."""
