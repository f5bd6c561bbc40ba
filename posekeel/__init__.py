"""Pose-annotation quality control and data processing on PySpark."""
