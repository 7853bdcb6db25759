"""Composed plans: hybrid search, evaluation, and the query registry."""
