"""Fixtures, reports and the registry of runnable queries with their SQL twins."""
