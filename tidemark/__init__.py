"""Labour-market posting analytics as PySpark DataFrame operators."""
