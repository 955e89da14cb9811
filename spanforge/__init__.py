"""spanforge: a PySpark-native analytics engine for coding-agent session logs."""

__version__ = "0.1.0"
