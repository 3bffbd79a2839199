"""Audit operators. Each returns a DataFrame."""
