"""Spark functions of the export-analytics engine."""
