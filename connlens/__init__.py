"""Network-connection analytics as Spark DataFrame operators."""
