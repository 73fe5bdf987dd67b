"""Governed, censoring-aware analytics over administrative event records, as Spark DataFrames."""
