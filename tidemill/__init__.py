"""Feed analytics as Spark DataFrame plans."""
