"""Consolidation and analytics of market data on Spark DataFrames."""
