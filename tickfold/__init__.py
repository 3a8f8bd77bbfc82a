"""Spark-native bars, features, labels, validation statistics and portfolios for financial time series."""
