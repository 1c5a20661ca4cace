"""vitrine: retail and search analytics as Spark DataFrame queries."""

__version__ = "0.1.0"
