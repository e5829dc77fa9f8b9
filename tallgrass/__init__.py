"""tallgrass: a Spark-native data-quality and data-preparation engine."""

__version__ = "0.1.0"
