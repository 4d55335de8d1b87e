"""Refill, catalog and conversation analytics on Spark."""
