"""Subgraph analytics and graph data processing on Spark DataFrames."""
