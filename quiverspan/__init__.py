"""A Spark-native engine for vector search, ranking and collection analytics."""
