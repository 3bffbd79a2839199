"""Registered queries over the supplied tables, each with the SQL that checks it."""

from __future__ import annotations

from catalog import decisions, leakage, modelling, profiling, quality, targets
from catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "decisions", "leakage", "modelling", "profiling", "quality", "targets"]
