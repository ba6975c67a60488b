"""Spark-native posting analytics: sources, functions, operators, plans and streaming."""
