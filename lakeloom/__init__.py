"""Analytics over Parquet and versioned tables, planned and run by Spark."""

__version__ = "0.1.0"
