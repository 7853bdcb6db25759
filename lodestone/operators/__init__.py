"""Relational operators: filters, joins, merges, ranking, aggregation."""
