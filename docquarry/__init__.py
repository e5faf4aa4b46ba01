"""A Spark-native document search and analytics engine."""
