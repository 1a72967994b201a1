"""Spark-first analytics over annotated matrices and point sets in long form."""
