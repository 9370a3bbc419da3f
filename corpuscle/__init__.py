"""A Spark-native analytics engine for content corpora."""
