"""folioflow: document analytics and retrieval on Spark DataFrames."""

__version__ = "0.1.0"
