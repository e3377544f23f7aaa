"""tidelog: log and event ingestion on Spark SQL and Structured Streaming.

Every operator is a function ``DataFrame -> DataFrame`` (no action inside).
"""

__version__ = "0.1.0"
