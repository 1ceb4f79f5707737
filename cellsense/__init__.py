"""Semantic table interpretation and corpus preparation as Spark DataFrame operators."""
