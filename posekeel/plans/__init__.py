"""Derived tables and whole runs."""
