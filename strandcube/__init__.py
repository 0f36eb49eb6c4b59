"""strandcube: a Spark-native warehouse, cube and mining engine."""

__version__ = "0.1.0"
