"""tessella: Spark-native profiling, key and relationship discovery over tables of any size."""

__version__ = "0.1.0"
