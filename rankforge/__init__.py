"""Multi-criteria ranking, recommendation and evaluation on Spark DataFrames."""

__version__ = "0.1.0"
