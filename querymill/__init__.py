"""Spark-native analytics over database catalogs, question/SQL corpora and schema graphs."""

__version__ = "0.1.0"
