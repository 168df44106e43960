"""A Spark-native text search and dataflow engine."""
