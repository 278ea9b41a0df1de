"""Composite plans and the query catalog."""
