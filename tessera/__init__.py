"""Tessera: batch text analytics and hybrid search as ordinary Spark DataFrames."""
