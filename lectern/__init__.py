"""Spark-first analytics over annotated documents and the relational tables around them."""
