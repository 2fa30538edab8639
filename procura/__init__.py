"""Purchasing analytics over monthly amounts, expressed as Spark DataFrame jobs."""
