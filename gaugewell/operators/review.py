"""Human review: checklist, stable item keys, decisions and payload checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PENDING = "pending_human_review"

# Final decisions a review payload may carry, and those that approve.
FINAL_DECISIONS = [
    "approved_for_baseline_experiment_only", "approved_with_known_risks", "pause_and_fix_data_first",
    "reject_modeling_until_fixed", "not_ready_pending_review",
]
FINAL_APPROVING = FINAL_DECISIONS[:2]
DECISION_OPTIONS = ["approved", "approved_with_notes", "needs_fix", "blocked"]

ITEM_COLUMNS = ["audit_id", "category", "severity", "column", "reason", "suggested_decision", "status"]
NO_ACTION = "No action needed."


def review_items(
    items: DataFrame, risks: DataFrame | None = None, actions: DataFrame | None = None, unsure: DataFrame | None = None
) -> DataFrame:
    """One checklist from four sources, each with an audit_id.

    items: risk items (category, severity, reason); risks: leakage risks
    (column, risk_level, reason); actions: quality actions (action); unsure:
    audits whose problem type needs a review (target_column, problem_reason).
    An empty action list adds nothing.
    """
    def shape(df, category, severity, column, reason, suggestion):
        return df.select(
            "audit_id", category.alias("category"), severity.alias("severity"), column.cast("string").alias("column"),
            reason.alias("reason"), F.lit(suggestion).alias("suggested_decision"), F.lit(PENDING).alias("status"),
        )
    none = F.lit(None)
    out = shape(items, F.col("category"), F.col("severity"), none, F.col("reason"), "review_before_modeling")
    if risks is not None:
        out = out.unionByName(shape(
            risks, F.lit("possible_leakage"), F.col("risk_level"), F.col("column"), F.col("reason"),
            "review_prediction_time_availability"))
    if actions is not None:
        real = actions.where(F.col("action") != NO_ACTION)
        out = out.unionByName(shape(
            real, F.lit("data_quality"), F.lit("review"), none, F.col("action"), "accept_or_plan_fix"))
    if unsure is not None:
        out = out.unionByName(shape(
            unsure, F.lit("problem_type"), F.lit("review"), F.col("target_column"),
            F.coalesce("problem_reason", F.lit("The problem type needs a review.")), "confirm_problem_type"))
    return normalise_items(out)


def normalise_items(items: DataFrame) -> DataFrame:
    """Fill defaults and add a key that is stable across runs and processes."""
    filled = items.withColumns({
        "category": F.coalesce("category", F.lit("review")), "severity": F.coalesce("severity", F.lit("review")),
        "suggested_decision": F.coalesce("suggested_decision", F.lit("review_before_modeling")),
        "status": F.coalesce("status", F.lit(PENDING)),
    })
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("audit_id", "category", "severity", "column", "reason", "suggested_decision")]
    return filled.withColumn("review_key", F.md5(F.concat_ws("\u001f", *parts)))


def merge_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Left join (review_key, human_decision, reviewer_note); undecided items stay pending."""
    return items.join(decisions.select("review_key", "human_decision", "reviewer_note"), "review_key", "left").withColumns({
        "human_decision": F.coalesce("human_decision", F.lit(PENDING)),
        "reviewer_note": F.coalesce("reviewer_note", F.lit("")),
    })


def review_summary(merged: DataFrame) -> DataFrame:
    """(audit_id, review_items_count, pending_items_count, is_pending)."""
    return merged.groupBy("audit_id").agg(
        F.count(F.lit(1)).alias("review_items_count"),
        F.count_if(F.col("human_decision") == PENDING).alias("pending_items_count"),
    ).withColumn("is_pending", F.col("pending_items_count") > 0)


def review_gate(scored: DataFrame, items: DataFrame) -> DataFrame:
    """Add the item count, whether a review is required and the next action to every scored audit."""
    counts = items.groupBy("audit_id").agg(F.count(F.lit(1)).alias("review_items_count"))
    return (
        scored.join(counts, "audit_id", "left").fillna(0, ["review_items_count"])
        .withColumn("review_required", F.expr("review_items_count > 0 OR readiness <> 'good_starting_point'"))
        .withColumn("next_action", F.expr("if(review_required, 'review_required_before_modeling', 'modeling_allowed')"))
    )


def check_payloads(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Parse JSON decision payloads and add `error` (null when the payload is valid)."""
    j = F.col(column)
    text = lambda path: F.get_json_object(j, path)
    out = payloads.withColumns({
        "final_human_decision": F.trim(F.coalesce(text("$.final_human_decision"), F.lit(""))),
        "pending_text": F.coalesce(text("$.pending_items_count"), F.lit("0")),
        "items_text": F.coalesce(text("$.reviewed_items"), F.lit("[]")),
        "approved_for_modeling": F.lower(F.coalesce(text("$.approved_for_modeling"), F.lit("false"))).isin("true", "1"),
    }).withColumn("pending_items_count", F.expr("try_cast(pending_text AS BIGINT)"))
    known = ", ".join(f"'{d}'" for d in FINAL_DECISIONS)
    approving = ", ".join(f"'{d}'" for d in FINAL_APPROVING)
    error = f"""CASE WHEN final_human_decision NOT IN ({known}) THEN 'unknown_final_decision'
        WHEN NOT startswith(ltrim(items_text), '[') THEN 'reviewed_items_not_a_list'
        WHEN pending_items_count IS NULL THEN 'pending_items_not_an_integer'
        WHEN pending_items_count > 0 AND approved_for_modeling THEN 'approved_with_pending_items'
        WHEN final_human_decision IN ({approving}) AND NOT approved_for_modeling THEN 'approval_without_flag' END"""
    return out.withColumn("error", F.expr(error)).withColumn("is_valid", F.col("error").isNull()).drop(
        "pending_text", "items_text"
    )
