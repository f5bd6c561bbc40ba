"""Detectors, checks, rankings and their analytics."""
