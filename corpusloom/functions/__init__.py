"""Scalar functions: column expressions where Spark has them, plain Python for parsing references and codes."""
