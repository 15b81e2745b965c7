"""Spark-native network-flow detection analytics."""
