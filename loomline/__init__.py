"""Spark-native retrieval, conversation analytics and training-data preparation."""
