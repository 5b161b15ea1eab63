"""Conserved-flow analytics on directed compartment networks, as Spark DataFrames; see README.md."""
