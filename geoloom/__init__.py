"""Earth-observation metadata and pixel analytics as Spark DataFrame queries."""
