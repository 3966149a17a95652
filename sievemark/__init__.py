"""Spark-native retrieval, grounded decisions and ranked-list evaluation."""
