"""Spark streaming of the export-analytics engine."""
