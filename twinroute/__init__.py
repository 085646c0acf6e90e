"""Spark-native analytics for two alignment routes of the same sequencing libraries."""
