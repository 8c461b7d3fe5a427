"""Table packaging and data quality checks as Spark DataFrame operations."""

__version__ = "0.1.0"
