"""Vessel-position (AIS) analytics as Spark DataFrame jobs."""
