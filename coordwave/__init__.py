"""Coordinated-signal analytics on Spark DataFrames."""
