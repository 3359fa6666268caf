"""Spark jobs for a corpus of articles: landing, text preparation, vector search, analytics."""
