"""Vessel-traffic analytics on Spark."""
