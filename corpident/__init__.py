"""Company-identifier validation over DataFrames."""

__version__ = "0.1.0"
