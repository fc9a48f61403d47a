"""Barwright: market-bar, flow-panel and training-text operators for Spark DataFrames."""
