"""Text-to-SQL corpus preparation and evaluation as Spark jobs."""

__version__ = "0.1.0"
