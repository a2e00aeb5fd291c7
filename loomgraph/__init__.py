"""Spark-first concept-graph retrieval and analytics engine."""
