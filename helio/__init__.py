"""helio — Spark DataFrame and Structured Streaming operators for solar and
geomagnetic observation tables and feeds."""

__version__ = "0.1.0"
