"""Incident evidence from logs, spans and metrics, as Spark DataFrame jobs."""
