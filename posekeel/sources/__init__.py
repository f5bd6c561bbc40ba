"""Readers: pose projects, review and label files, bundles, models, settings."""
