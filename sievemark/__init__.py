"""sievemark: a PySpark-native engine that audits crawled websites at corpus scale."""

__version__ = "0.1.0"
