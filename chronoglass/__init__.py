"""Spark-native analytics for irregularly sampled time series."""
