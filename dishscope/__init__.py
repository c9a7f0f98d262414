"""Calibrated image measurement of culture plates as Spark DataFrames."""

__version__ = "0.1.0"
