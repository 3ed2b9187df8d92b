"""Gristmill: a Spark-native engine for findings over source code and text."""
