"""Spark-first incident fusion: message tables in, incident and analytics tables out."""
