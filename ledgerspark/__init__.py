"""Spark-first analytics over content-delivery ledgers."""
