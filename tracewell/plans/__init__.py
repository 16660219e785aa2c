"""Queries over the test tables: adapters and the catalog."""
