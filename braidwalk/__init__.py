"""Pangenome anchor analytics on Spark DataFrames."""
