"""Leak scanning and reliability analytics over Spark DataFrames."""
