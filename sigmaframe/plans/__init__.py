"""Composed queries and the catalogue of registered queries."""
