"""Spark-native RDF quad analytics: SPARQL queries and updates compiled to DataFrame plans."""
