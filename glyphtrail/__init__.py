"""glyphtrail: a Spark-native engine for timestamped text observations."""
