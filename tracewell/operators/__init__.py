"""Spark operators of the export-analytics engine."""
