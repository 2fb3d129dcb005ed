"""Tessera: ranked retrieval, routing and evaluation as Spark DataFrame plans."""
