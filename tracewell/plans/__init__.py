"""Spark plans of the export-analytics engine."""
