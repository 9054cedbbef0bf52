"""Siltstone: document-knowledge analytics as DataFrame operators on Apache Spark."""
