"""Audit labelled tables on Spark before a model is trained on them."""

from gaugewell.errors import AuditError, TargetError, TrainingError
from gaugewell.plans.audit import Audit, Spec, after_approval, audit, audit_many, checks, decide, review_gate
from gaugewell.sources.readers import read_csv, read_table

__all__ = [
    "Audit", "AuditError", "Spec", "TargetError", "TrainingError", "after_approval", "audit", "audit_many", "checks",
    "decide", "read_csv", "read_table", "review_gate",
]
