"""Relational operators: windows, joins, aggregates, shaping, quality, models."""
