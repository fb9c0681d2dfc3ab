"""Hybrid retrieval and graph analytics over source trees, written as Spark DataFrame plans."""
