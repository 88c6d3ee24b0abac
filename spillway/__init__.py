"""Network and DNS traffic analytics as Spark DataFrame operators."""
