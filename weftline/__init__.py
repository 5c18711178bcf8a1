"""Weftline: a PySpark-native engine for content, link and relevance analytics."""
