"""siftstone: a PySpark-native engine for document retrieval, evaluation and corpus preparation."""
