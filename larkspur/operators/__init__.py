"""Filters, joins, rollups, selection, statistics, screening and model tables."""
