"""Relational operators: filters, joins, aggregates, ranking, spatial joins, rasters."""
