"""Spark-native analytics for receptor-antigen data: pure DataFrame -> DataFrame operators."""

__version__ = "0.1.0"
