"""gramwell: approximate text search over large collections, built on DataFrames."""

__version__ = "0.1.0"
