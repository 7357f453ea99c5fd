"""Spark sources of the export-analytics engine."""
