"""Content inventory, duplicate analysis and path policy on Spark DataFrames."""

__version__ = "0.1.0"
