"""weftline: a Spark-native property-graph, retrieval and corpus-preparation engine."""

__version__ = "0.1.0"
