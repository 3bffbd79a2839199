"""Composite audits."""
