"""Log search, field discovery and live follow as Spark jobs."""

__version__ = "0.1.0"
