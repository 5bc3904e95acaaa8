"""Spark-native analysis of event streams: rules, features, online detectors, scoring and log queries."""
