"""Relational operators over DataFrames: long form, windows, joins, aggregates, DML, ratings, models."""
