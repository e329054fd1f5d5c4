"""Folioforge: a PySpark-native engine for document libraries, retrieval and provenance."""
