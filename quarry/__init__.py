"""quarry: a Spark-native engine for text-memory retrieval, evaluation and corpus preparation."""
