"""Spark-native sensitive-data analytics: detect, score, decide, mask and audit text at scale."""
