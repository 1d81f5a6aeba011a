"""Marketplace growth analytics expressed as Spark DataFrame jobs."""
