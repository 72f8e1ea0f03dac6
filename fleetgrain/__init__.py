"""Transit-operations analytics as PySpark DataFrame operators."""
