"""Property-graph analytics and data-preparation operators on Spark DataFrames."""

__version__ = "0.1.0"
