"""millrace: a PySpark-native engine for text retrieval and analytics."""
