"""Ontology analytics on Spark: terms, profiles, similarity, text and search."""

__version__ = "0.1.0"
