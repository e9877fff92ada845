"""Scalar functions as Spark columns, and the system-call dimension."""
