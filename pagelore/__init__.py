"""Document-analytics operators written as Spark DataFrame programs."""

__version__ = "0.1.0"
