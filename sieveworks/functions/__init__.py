"""Scalar functions as Column expressions, and as Arrow UDFs where Spark has no expression."""
