"""bookflow: a Spark-native engine for serial-text pipelines."""

__version__ = "0.1.0"
