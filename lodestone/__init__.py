"""Spark-native prospect analytics: operators over web pages, search hits and job tables."""
