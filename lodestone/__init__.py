"""Lodestone: a PySpark-native engine for personal-library analytics."""
