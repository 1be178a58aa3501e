"""plumbline: evidence and review analytics as plain Spark DataFrame operators."""
