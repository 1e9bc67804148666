"""Spatial-distribution analytics expressed as Spark DataFrame jobs."""
