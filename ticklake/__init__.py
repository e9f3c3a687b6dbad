"""ticklake: a Spark-first engine for tick data, point-in-time research and training-corpus work."""

__version__ = "0.1.0"
