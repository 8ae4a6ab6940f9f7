"""Search, ingestion, graph and evaluation analytics over a collection of notes, on Spark."""
