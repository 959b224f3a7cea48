"""Staging of intermediate tables, derived test clouds and the query registry."""
