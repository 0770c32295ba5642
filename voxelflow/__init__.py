"""Spark-first analytics over image volumes, label fields and particle tracks."""
