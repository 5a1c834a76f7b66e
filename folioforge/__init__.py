"""Spark-first analytics over scanned pages, the readings of several recognisers and page texts."""
