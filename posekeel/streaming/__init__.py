"""Incremental scoring of edited instances."""
