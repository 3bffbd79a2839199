"""Whole audits: one (table, target) pair or many, with the review gate and the modelling steps after it."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F

from gaugewell.errors import AuditError
from gaugewell.functions.small import small_table
from gaugewell.operators import (
    explain, imbalance, leakage, metrics, models, problem, profile, quality, report, review, risk,
)
from gaugewell.operators.facts import Facts
from gaugewell.operators.schema import check_structure, require_features, validate_target

AUDIT_SCHEMA = {
    "audit_id": "string", "target_column": "string", "problem_type": "string", "problem_needs_review": "boolean",
    "problem_reason": "string", "quality_score": "double", "health_label": "string", "duplicate_rows": "long",
    "leakage_severity": "string", "leakage_count": "long", "imbalance_severity": "string", "optional_failures": "long",
    "best_model": "string", "selection_metric": "string", "best_score": "double", "explanation_method": "string",
    "top_feature": "string",
}


@dataclass
class Audit:
    """Tables of one audit. `row` is its line in the audits table, `tables` the detail tables by name."""

    audit_id: str
    target: str
    row: dict[str, Any]
    tables: dict[str, DataFrame]
    baseline: models.Baseline | None = None
    explanation: dict[str, Any] | None = None
    failures: list[str] = field(default_factory=list)


_NEED = set().union(*quality.NEEDS.values()) | {"numeric", "labels", "dates"}


def checks(df: DataFrame, target: str, audit_id: str = "audit", cache: bool = False, facts: Facts | None = None, **limits) -> Audit:
    """Profile, problem type, quality, leakage and imbalance over one shared set of column facts.

    `facts` of the same table, gathered for another target or none, are used as they are.

    `cache` keeps the input in memory and on disk between the passes; worth it
    when the table is derived or fits, not for a large parquet scan.
    """
    check_structure(df)
    target = validate_target(df, target)
    require_features(df, target)
    source = df.persist() if cache else df
    try:
        facts = facts.for_target(target) if facts else quality.gather_facts(source, target, _NEED, **{k: v for k, v in limits.items() if k in quality.LIMITS})
        kind = problem.detect(source, target, facts).first()
        found = quality.quality_audit(source, target, facts, **{k: v for k, v in limits.items() if k in quality.LIMITS})
        leaks = leakage.leakage_check(source, target, facts, **{k: v for k, v in limits.items() if k in leakage.LIMITS})
        skew = imbalance.imbalance_audit(source, target, kind["problem_type"])
    finally:
        if cache:
            source.unpersist()
    score, overall, balance = found["score"].first(), leaks["overall"].first(), skew["summary"].first().asDict()
    repeated = [r for r in found["findings"].where("category = 'duplicate_rows'").collect()]
    row = {
        "audit_id": audit_id, "target_column": target, "problem_type": kind["problem_type"],
        "problem_needs_review": kind["needs_human_review"], "problem_reason": kind["reason"], "quality_score": score["score"],
        "health_label": score["health_label"], "duplicate_rows": int(repeated[0]["evidence"]["duplicate_rows"]) if repeated else 0,
        "leakage_severity": overall["overall_severity"], "leakage_count": overall["total_risks"],
        "imbalance_severity": balance.get("imbalance_severity") or "not_applicable", "optional_failures": 0,
    }
    tables = {
        "column_types": profile.column_types(df, facts=facts), "numeric": profile.numeric_summary(df, facts=facts),
        "problem_type": problem.problem_types(df, [target], facts), "findings": found["findings"], "columns": found["columns"],
        "quality_actions": found["actions"], "risks": leaks["risks"], "review_columns": leaks["review_columns"],
        "leakage_actions": leaks["actions"], "imbalance": skew["summary"],
    }
    return Audit(audit_id, target, row, tables)


def audits_table(audits: list[Audit]) -> DataFrame:
    """One row per audit."""
    if not audits:
        raise AuditError("No audits.")
    spark = audits[0].tables["findings"].sparkSession
    return small_table(spark, [a.row for a in audits], AUDIT_SCHEMA)


def stacked(audits: list[Audit], name: str) -> DataFrame:
    """A detail table of all audits with their audit_id."""
    out = None
    for a in audits:
        part = a.tables[name].withColumn("audit_id", F.lit(a.audit_id))
        out = part if out is None else out.unionByName(part)
    return out


def decide(audits: list[Audit], mode: str = "auto", decisions: DataFrame | None = None, stop_on_critical: bool = False) -> dict[str, DataFrame]:
    """Decision, score and review checklist of all audits together, from their tables; nothing is recomputed."""
    table = audits_table(audits)
    aggregated = risk.aggregate(table)
    routed = risk.verdict(risk.audit_score(risk.route(aggregated, mode, decisions, stop_on_critical)))
    recommended = metrics.recommend(table.select("audit_id", "problem_type", "imbalance_severity")).select(
        "audit_id", "primary_metric", "scoring_metric")
    routed = routed.join(recommended, "audit_id", "left")
    unsure = aggregated.where("problem_needs_review").select("audit_id", "target_column", "problem_reason")
    items = review.review_items(risk.risk_items(aggregated), stacked(audits, "risks"), stacked(audits, "quality_actions"), unsure)
    gated = review.review_gate(routed, items)
    return {
        "decisions": gated, "risk_items": risk.risk_items(aggregated), "review_items": items, "summary": risk.compact_summary(gated),
        "reports": report.markdown(gated), "contexts": report.context_hash(table),
    }


def model(audit: Audit, df: DataFrame, key: str | list[str] | None = None, settings: models.Settings | None = None, explained: bool = True) -> Audit:
    """Train and explain the baselines of an audit that may go on. A failing explanation is counted, not raised."""
    audit.baseline = models.train_baselines(df, audit.target, audit.row["problem_type"], key, settings)
    best = audit.baseline.best.first()
    audit.row |= {"best_model": best["model"], "selection_metric": best["selection_metric"], "best_score": best["score"]}
    audit.tables["model_metrics"] = audit.baseline.metrics
    if explained:
        try:
            audit.explanation = explain.explain_model(audit.baseline.models[best["model"]], audit.baseline.test, key)
            line = audit.explanation["summary"].first()
            audit.row |= {"explanation_method": line["method"], "top_feature": line["top_feature"]}
        except Exception as error:  # an optional step
            audit.failures.append(f"explain: {error}")
            audit.row["optional_failures"] += 1
    return audit


@dataclass
class Spec:
    """One audit of `audit_many`."""

    audit_id: str
    df: DataFrame
    target: str
    key: str | list[str] | None = None


def audit_many(
    specs: list[Spec], mode: str = "auto", decisions: DataFrame | None = None, settings: models.Settings | None = None,
    train: bool = True, stop_on_critical: bool = False, done: list[Audit] | None = None, **limits,
) -> tuple[list[Audit], dict[str, DataFrame]]:
    """Check every spec, decide on all of them at once and train those that may go on.

    Specs over one DataFrame share its column facts and its searches for repeated rows and columns, which are made once; only what
    depends on the target is computed for each. With `exact_distinct` off every spec gathers its own, as a target stays exact.

    `done` are audits of an earlier call: after a review the decisions are joined
    to them, and the checks do not run again.
    """
    shared: dict[int, Facts] = {}
    quality_limits = {k: v for k, v in limits.items() if k in quality.LIMITS}
    if not done and limits.get("exact_distinct", True):
        frames = [id(s.df) for s in specs]
        shared = {id(s.df): s.df for s in specs if frames.count(id(s.df)) > 1}
        shared = {i: quality.gather_facts(df, None, _NEED, **quality_limits) for i, df in shared.items()}
    audits = done or [checks(s.df, s.target, s.audit_id, facts=shared.get(id(s.df)), **limits) for s in specs]
    outcome = decide(audits, mode, decisions, stop_on_critical)
    if train:
        open_ids = {r["audit_id"] for r in outcome["decisions"].where("decision = 'continue_to_modeling'").select("audit_id").collect()}
        by_id = {s.audit_id: s for s in specs}
        for a in audits:
            if a.audit_id in open_ids and a.audit_id in by_id:
                model(a, by_id[a.audit_id].df, by_id[a.audit_id].key, settings)
        outcome = decide(audits, mode, decisions, stop_on_critical)
    return audits, outcome


def audit(df: DataFrame, target: str, key: str | list[str] | None = None, mode: str = "auto", **options) -> tuple[Audit, dict[str, DataFrame]]:
    """Full audit of one table and target."""
    audits, outcome = audit_many([Spec("audit", df, target, key)], mode, **options)
    return audits[0], outcome


def review_gate(df: DataFrame, target: str, **limits) -> tuple[Audit, dict[str, DataFrame]]:
    """Checks and decision only; stops whenever something needs a review."""
    return audit(df, target, mode="human_gate", train=False, **limits)


def after_approval(audited: Audit, df: DataFrame, decisions: DataFrame, key: str | list[str] | None = None, settings: models.Settings | None = None):
    """Go on with an audit once decisions (audit_id, final_human_decision, approved_for_modeling) are there."""
    audits, outcome = audit_many([Spec(audited.audit_id, df, audited.target, key)], "human_approved", decisions, settings, done=[audited])
    return audits[0], outcome


