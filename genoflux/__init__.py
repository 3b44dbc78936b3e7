"""Spark-native interval, coverage, copy-number and flow analytics."""
