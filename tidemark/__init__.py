"""Catalogue curation, duplicate resolution and record linkage on Spark DataFrames."""

__version__ = "0.1.0"
