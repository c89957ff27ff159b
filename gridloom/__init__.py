"""Spark-native spatio-temporal fusion and pattern analysis."""
