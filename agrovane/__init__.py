"""Agro-climatic risk analytics expressed as Spark DataFrame jobs."""
