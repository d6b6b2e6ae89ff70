"""Species-occurrence analytics as Spark DataFrame operators."""
