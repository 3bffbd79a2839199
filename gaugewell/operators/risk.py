"""From audit results to a decision: aggregation, router, approval and score.

All functions work on an `audits` table with one row per (table, target):
audit_id, target_column, problem_type, problem_needs_review, problem_reason,
quality_score, leakage_severity, leakage_count, imbalance_severity and
optional_failures. Many audits are decided in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugewell.errors import AuditError

# Workflow modes and human decisions.
MODES = ["auto", "human_gate", "human_approved"]
APPROVING = [
    "approved_for_baseline_experiment_only", "approved_with_known_risks", "accept_risk_continue", "approved",
    "approved_with_notes",
]
BLOCKING = [
    "pause_and_fix_data_first", "reject_modeling_until_fixed", "needs_fix", "blocked", "not_ready_pending_review",
]
CRITICAL_QUALITY, REVIEW_QUALITY = 40.0, 70.0


def _in(column: str, values: list[str]) -> str:
    return f"coalesce({column}, '') IN ({', '.join(repr(v) for v in values)})"


_LEAK_SEVERE = _in("leakage_severity", ["critical", "severe", "high"])
_LEAK_REVIEW = f"(coalesce(leakage_count, 0) > 0 OR {_in('leakage_severity', ['medium', 'moderate', 'review'])})"


def _item(when: str, category: str, severity: str, reason: str) -> str:
    return (
        f"CASE WHEN {when} THEN named_struct('category', '{category}', 'severity', {severity}, 'reason', {reason}) END"
    )


def _list(*pairs: tuple[str, str]) -> str:
    arms = ", ".join(f"CASE WHEN {when} THEN '{name}' END" for when, name in pairs)
    return f"array_compact(array({arms}))"


def aggregate(audits: DataFrame, critical: float = CRITICAL_QUALITY, review: float = REVIEW_QUALITY) -> DataFrame:
    """Add critical_blockers, risk_warnings, risk_items and what follows from them."""
    low = f"quality_score < {critical}"
    middling = f"quality_score >= {critical} AND quality_score < {review}"
    skewed = _in("imbalance_severity", ["severe", "high"])
    unsure = "coalesce(problem_needs_review, false)"
    items = ", ".join([
        _item(low, "data_quality", "'critical'", "concat('The quality score is very low: ', quality_score, '.')"),
        _item(middling, "data_quality", "'review'", "concat('The quality score needs a review: ', quality_score, '.')"),
        _item(_LEAK_SEVERE, "possible_leakage", "leakage_severity", "'Serious possible leakage.'"),
        _item(f"NOT {_LEAK_SEVERE} AND {_LEAK_REVIEW}", "possible_leakage", "leakage_severity", "'Possible leakage needs a review.'"),
        _item(skewed, "class_imbalance", "imbalance_severity", "'Class imbalance can distort scores.'"),
        _item(unsure, "problem_type", "'review'", "coalesce(problem_reason, 'The problem type needs a review.')"),
    ])
    blockers = _list((low, "data_quality_below_critical_threshold"), (_LEAK_SEVERE, "severe_possible_leakage"))
    warnings = _list(
        (middling, "data_quality_needs_review"), (f"NOT {_LEAK_SEVERE} AND {_LEAK_REVIEW}", "possible_leakage_needs_review"),
        (skewed, "class_imbalance_needs_review"), (unsure, "problem_type_needs_review"),
    )
    return (
        audits.withColumns({
            "critical_blockers": F.expr(blockers), "risk_warnings": F.expr(warnings),
            "risk_items": F.expr(f"array_compact(array({items}))"),
        })
        .withColumns({
            "has_blockers": F.size("critical_blockers") > 0,
            "risk_items_count": F.size("risk_items").cast("long"),
        })
        .withColumn("requires_human_review", F.expr("has_blockers OR risk_items_count > 0"))
    )


def risk_items(aggregated: DataFrame) -> DataFrame:
    """(audit_id, category, severity, reason): one row per risk item."""
    return aggregated.select("audit_id", F.inline("risk_items"))


def approval(decisions: DataFrame) -> DataFrame:
    """Add human_approved and human_blocked to (final_human_decision, approved_for_modeling) rows."""
    final = "lower(trim(coalesce(final_human_decision, '')))"
    listed = lambda values: f"{final} IN ({', '.join(repr(v) for v in values)})"
    return decisions.withColumns({
        "human_approved": F.expr(f"{listed(APPROVING)} OR coalesce(approved_for_modeling, false)"),
        "human_blocked": F.expr(listed(BLOCKING)),
    })


def route(
    aggregated: DataFrame, mode: str = "auto", decisions: DataFrame | None = None, stop_on_critical: bool = False
) -> DataFrame:
    """Add the router decision and workflow status to every aggregated audit.

    `decisions` has one row per audit_id with final_human_decision and
    approved_for_modeling. In auto mode blockers stop an audit only when
    `stop_on_critical` is set.
    """
    if mode not in MODES:
        raise AuditError(f"Unsupported workflow mode: {mode}")
    if decisions is None:
        joined = aggregated.withColumns({"human_approved": F.lit(False), "human_blocked": F.lit(False)})
    else:
        known = approval(decisions).select("audit_id", "human_approved", "human_blocked")
        joined = aggregated.join(known, "audit_id", "left").fillna(False, ["human_approved", "human_blocked"])
    goes_on = {
        "human_approved": "human_approved", "human_gate": "NOT requires_human_review",
        "auto": f"NOT has_blockers OR {str(not stop_on_critical).lower()}",
    }[mode]
    return (
        joined.withColumn("workflow_mode", F.lit(mode))
        .withColumn("continue_after_review", F.expr(f"NOT human_blocked AND ({goes_on})"))
        .withColumn("decision", F.expr(
            "CASE WHEN human_blocked THEN 'human_rejected_modeling' "
            "WHEN requires_human_review AND NOT continue_after_review THEN 'wait_for_human_approval' "
            "ELSE 'continue_to_modeling' END"))
        .withColumn("workflow_status", F.expr(
            "if(decision = 'continue_to_modeling', 'continue_to_modeling', 'waiting_for_human_approval')"))
    )


def audit_score(aggregated: DataFrame) -> DataFrame:
    """Add the penalties, the score in 0..100 and the readiness label."""
    # Decimal arithmetic: the score is exact before it is rounded.
    low = f"CASE WHEN leakage_severity = 'critical' THEN 30 WHEN {_in('leakage_severity', ['severe', 'high'])} THEN 20 "
    low += f"WHEN {_in('leakage_severity', ['medium', 'moderate'])} THEN 10 WHEN coalesce(leakage_count, 0) > 0 THEN 5 ELSE 0 END"
    parts = {
        "quality_penalty": "greatest(0, 100 - CAST(coalesce(quality_score, 100) AS DECIMAL(12, 4))) * CAST(0.35 AS DECIMAL(3, 2))",
        "leakage_penalty": low,
        "imbalance_penalty": "CASE imbalance_severity WHEN 'severe' THEN 12 WHEN 'high' THEN 8 WHEN 'moderate' THEN 4 ELSE 0 END",
        "failure_penalty": "least(10, 3 * coalesce(optional_failures, 0))",
        "blocker_penalty": "if(has_blockers, 15, 0)",
    }
    raw = "100 - " + " - ".join(parts)
    label = ("CASE WHEN raw_score >= 85 THEN 'good_starting_point' WHEN raw_score >= 70 THEN 'needs_review' "
             "WHEN raw_score >= 50 THEN 'high_review_needed' ELSE 'not_ready' END")
    return (
        aggregated.withColumns({k: F.expr(v) for k, v in parts.items()})
        .withColumn("raw_score", F.expr(f"greatest(0, least(100, {raw}))"))
        .withColumns({"readiness": F.expr(label), "audit_score": F.round("raw_score", 2).cast("double")})
        .withColumns({k: F.col(k).cast("double") for k in parts})
        .drop("raw_score")
    )


def verdict(scored: DataFrame) -> DataFrame:
    """Add a one-word verdict: blocked, good, review or high_review."""
    text = ("CASE WHEN lower(workflow_status) = 'blocked_for_review' THEN 'blocked' WHEN readiness = 'good_starting_point' "
            "THEN 'good' WHEN readiness = 'needs_review' THEN 'review' ELSE 'high_review' END")
    return scored.withColumn("verdict", F.expr(text))


def severity_rank(column: str):
    """Risk-first sort rank of a severity label."""
    return F.expr(
        f"CASE lower({column}) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'major' THEN 1 WHEN 'medium' THEN 2 "
        "WHEN 'moderate' THEN 2 WHEN 'minor' THEN 3 WHEN 'low' THEN 3 WHEN 'review' THEN 4 WHEN 'none' THEN 5 ELSE 6 END"
    )


def compact_summary(scored: DataFrame) -> DataFrame:
    """The columns a caller needs from one audit."""
    return scored.select(
        "audit_id", "target_column", "problem_type", "workflow_status", "audit_score", "readiness", "has_blockers",
        "requires_human_review", "risk_items_count", F.coalesce("leakage_count", F.lit(0)).alias("leakage_count"),
        F.coalesce("leakage_severity", F.lit("none")).alias("leakage_severity"),
    )
