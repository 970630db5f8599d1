"""papyrine: a PySpark-native analytics engine for digitised-archive corpora."""

__version__ = "0.1.0"
