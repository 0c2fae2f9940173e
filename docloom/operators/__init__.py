"""Operators over collections: aggregation, joins, secondary indexes."""
