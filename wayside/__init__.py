"""Public-transit performance analytics as PySpark DataFrame operators."""
