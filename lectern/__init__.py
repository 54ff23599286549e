"""A Spark-native engine for learning analytics and lecture content."""
