"""A Spark-native engine for document retrieval, evaluation and session analytics."""
