"""textweir: Spark-native preparation and retrieval of text datasets."""

__version__ = "0.1.0"
