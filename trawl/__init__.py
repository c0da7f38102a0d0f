"""Trawl: text-retrieval analytics as composable Spark DataFrame operators."""
