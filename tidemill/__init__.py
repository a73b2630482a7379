"""tidemill: a Spark-native engine for code, document and training-corpus intelligence."""

__version__ = "0.1.0"
