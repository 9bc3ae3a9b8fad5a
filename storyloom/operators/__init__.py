"""Filters, search, joins, facets, analytics, ingestion and identity repair over story tables."""
