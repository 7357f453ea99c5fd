"""Export analytics and training-data preparation, expressed as Spark DataFrame jobs."""
