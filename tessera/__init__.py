"""Tessera: a Spark-native text-retrieval analytics engine."""
