"""Licensing-records analytics on Spark."""
