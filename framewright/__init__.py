"""framewright: a Spark-native engine for retrieval and media-analytics data."""

__version__ = "0.1.0"
