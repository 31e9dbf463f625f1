"""Code-review analytics as Spark DataFrame operators."""
