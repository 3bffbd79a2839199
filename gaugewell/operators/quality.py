"""Data-quality findings, their score and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gaugewell.functions import cells, names
from gaugewell.functions.small import small_table
from gaugewell.operators import facts as facts_mod, profile, stats
from gaugewell.operators.facts import Facts
from gaugewell.operators.schema import check_structure, require_features, resolve_target

# Severities in order, penalty of one finding, and the most one category may take.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
PENALTIES = {"critical": 35.0, "high": 15.0, "medium": 7.0, "low": 2.0, "info": 0.0}
CATEGORY_CAPS = {
    "high_missing_values": 30.0, "moderate_missing_values": 21.0, "near_constant_column": 10.0, "outliers": 12.0,
    "rare_categories": 8.0, "possible_id_column": 30.0, "high_cardinality_column": 30.0,
}

LIMITS = {
    "missing_medium": 20.0, "missing_high": 50.0, "near_constant": 95.0, "cardinality": 50, "id_unique": 95.0,
    "rare_percent": 1.0, "rare_share": 20.0, "iqr_multiplier": 1.5, "outlier_min_values": 10, "outlier_medium": 5.0,
    "duplicate_high": 5.0, "numeric_ids": False, "exact_distinct": True,
}

FINDING_SCHEMA = {
    "severity": "string", "category": "string", "column": "string", "message": "string", "evidence": "map",
    "recommendation": "string",
}

# Facts each check needs on top of the missing counts.
NEEDS = {
    "target": {"frequency"}, "missing": set(), "constant": {"frequency"}, "near_constant": {"frequency"},
    "cardinality": {"frequency"}, "ids": {"frequency"}, "mixed": {"classes"}, "infinite": {"infinite"},
    "outliers": {"outliers"}, "rare": {"frequency"}, "duplicate_rows": set(), "duplicate_columns": set(),
}
COLUMN_CHECKS = [k for k in NEEDS if not k.startswith("duplicate_")]


def _evidence(*fields: str) -> str:
    pairs = ", ".join(f"'{f}', CAST({f} AS STRING)" for f in fields)
    return f"map({pairs})"


def _rule(when: str, severity: str, category: str, message: str, advice: str, evidence: str) -> str:
    return (
        f"CASE WHEN {when} THEN named_struct('severity', {severity}, 'category', {category}, 'column', column, "
        f"'message', {message}, 'evidence', {evidence}, 'recommendation', {advice}) END"
    )


def _rules(k: dict) -> dict[str, str]:
    """One SQL rule per column check, over the facts table with its derived columns."""
    feature, string = "NOT is_target", "type_group = 'categorical'"
    unique = _evidence("n_distinct", "unique_percent")
    return {
        "target": _rule(
            "is_target AND n_distinct < 2", "'critical'", "'invalid_target'",
            "'The target has fewer than two distinct values.'", "'Choose a target with at least two values.'",
            _evidence("dtype", "n_missing", "n_distinct"),
        ),
        "missing": _rule(
            f"(is_target AND missing_percent > 0) OR ({feature} AND missing_percent >= {k['missing_medium']})",
            f"if(is_target OR missing_percent >= {k['missing_high']}, 'high', 'medium')",
            f"CASE WHEN is_target THEN 'target_missing_values' WHEN missing_percent >= {k['missing_high']} "
            "THEN 'high_missing_values' ELSE 'moderate_missing_values' END",
            "concat(missing_percent, '% of the cells are missing.')",
            f"CASE WHEN is_target THEN 'Drop rows without a target.' WHEN missing_percent >= {k['missing_high']} "
            "THEN 'Drop the column or fill it with domain knowledge.' ELSE 'Fill the gaps and watch their pattern.' END",
            _evidence("n_missing", "missing_percent"),
        ),
        "constant": _rule(
            f"{feature} AND n_distinct + if(n_missing > 0, 1, 0) <= 1", "'medium'", "'constant_column'",
            "'All cells are equal.'", "'Drop the constant column.'", _evidence("n_distinct", "n_missing"),
        ),
        "near_constant": _rule(
            f"{feature} AND n_rows > 0 AND dominant_percent >= {k['near_constant']}", "'low'", "'near_constant_column'",
            "concat('One cell value fills ', dominant_percent, '% of the rows.')", "'Check whether the column is of use.'",
            _evidence("dominant_value", "dominant_count", "dominant_percent"),
        ),
        "cardinality": _rule(
            f"{feature} AND {string} AND n_distinct >= {k['cardinality']}",
            f"if(unique_percent >= {k['id_unique']}, 'high', 'medium')", "'high_cardinality_column'",
            "concat(n_distinct, ' distinct values (', unique_percent, '% of the rows).')",
            "'Do not one-hot encode this column as it is.'", unique,
        ),
        "ids": _rule(
            f"{feature} AND (id_by_name OR id_by_value)", "if(id_by_value, 'high', 'medium')", "'possible_id_column'",
            "concat('Looks like an identifier: ', n_distinct, ' distinct values.')",
            "'Drop the identifier unless it is known at prediction time.'",
            _evidence("n_distinct", "unique_percent", "id_by_name", "id_by_value", "dtype"),
        ),
        "mixed": _rule(
            f"{feature} AND {string} AND n_classes > 1", "'medium'", "'mixed_type_column'",
            "concat('Text cells of ', n_classes, ' kinds in one column.')", "'Bring the column to one kind of value.'",
            _evidence("n_int", "n_float", "n_bool", "n_timestamp", "n_text"),
        ),
        "infinite": _rule(
            "pos_inf + neg_inf > 0", "if(is_target, 'high', 'medium')", "'infinite_values'",
            "concat(pos_inf + neg_inf, ' infinite cells.')",
            "if(is_target, 'Replace or drop infinite target values.', 'Turn infinite cells into missing ones.')",
            _evidence("pos_inf", "neg_inf"),
        ),
        "outliers": _rule(
            f"{feature} AND n_outliers > 0",
            f"if(outlier_percent >= {k['outlier_medium']}, 'medium', 'low')", "'outliers'",
            "concat(n_outliers, ' cells lie outside the quartile fences (', outlier_percent, '%).')",
            "'Look at the outliers before removing any.'", _evidence("n_outliers", "outlier_percent", "lower", "upper"),
        ),
        "rare": _rule(
            f"{feature} AND {string} AND n_rare > 0 AND rare_percent >= {k['rare_share']} AND {k['rare_percent']} > 0",
            "'low'", "'rare_categories'",
            f"concat(n_rare, ' of ', n_distinct, ' values are rarer than {k['rare_percent']}%.')",
            "'Group rare values together.'", _evidence("n_rare", "n_distinct", "rare_percent"),
        ),
    }


def enrich(table: DataFrame, limits: dict | None = None) -> DataFrame:
    """Add what the rules read: name rule, rates and class counts."""
    k = LIMITS | (limits or {})
    by_value = (F.col("unique_percent") >= k["id_unique"]) & (
        F.lit(bool(k["numeric_ids"])) | (F.col("type_group") == "categorical")
    )
    present = [F.expr(f"if(coalesce(n_{c}, 0) > 0, 1, 0)") for c in stats.TEXT_CLASSES]
    return table.withColumns(
        {
            "id_by_name": names.looks_like_id(F.col("column"), names.ID_WORDS_QUALITY),
            "id_by_value": F.coalesce(by_value, F.lit(False)),
            "n_classes": sum(present[1:], present[0]),
            "outlier_percent": cells.percent(F.col("n_outliers"), F.col("n_valid")),
            "rare_percent": cells.percent(F.col("n_rare"), F.col("n_distinct")),
        }
    )


def _ranked(findings: DataFrame) -> DataFrame:
    ranks = ", ".join(f"'{s}'" for s in SEVERITIES)
    return findings.withColumns(
        {
            "severity_rank": F.expr(f"CAST(array_position(array({ranks}), severity) - 1 AS BIGINT)"),
            "requires_human_review": F.col("severity").isin("critical", "high", "medium"),
        }
    )


def column_findings(facts: Facts, checks: list[str], limits: dict | None = None) -> DataFrame:
    """All wanted column rules in one projection over the facts table."""
    rules = _rules(LIMITS | (limits or {}))
    arms = ", ".join(rules[c] for c in checks if c in rules)
    found = enrich(facts.table, limits).select(F.inline(F.expr(f"array_compact(array({arms}))")))
    return _ranked(found)


def _table_findings(df: DataFrame, checks: list[str], limits: dict, facts: Facts | None = None) -> DataFrame:
    rows, once = [], facts.once if facts else lambda _, make: make()
    if "duplicate_rows" in checks:
        d = once("duplicate_rows", lambda: profile.duplicate_rows(df).first())
        if d["duplicate_rows"]:
            pct = d["duplicate_percent"]
            rows.append({
                "severity": "medium" if pct < limits["duplicate_high"] else "high", "category": "duplicate_rows",
                "message": f"{d['duplicate_rows']} rows repeat another row ({pct}%).",
                "evidence": {"duplicate_rows": str(d["duplicate_rows"]), "duplicate_percent": str(pct)},
                "recommendation": "Remove repeated rows unless they are real observations.",
            })
    if "duplicate_columns" in checks:
        rows += [
            {
                "severity": "medium", "category": "duplicate_columns", "column": later,
                "message": f"Same cells as column '{first}'.", "evidence": {"column_a": first, "column_b": later},
                "recommendation": "Keep one of the equal columns.",
            }
            for first, later in once("duplicate_columns", lambda: stats.duplicate_column_pairs(df))
        ]
    return _ranked(small_table(df.sparkSession, rows, FINDING_SCHEMA))


def findings(
    df: DataFrame, target: str, checks: list[str] | None = None, facts: Facts | None = None, **limits
) -> DataFrame:
    """Findings of the wanted checks (all by default).

    Columns: severity, category, column, message, evidence, recommendation,
    severity_rank, requires_human_review.
    """
    k = LIMITS | limits
    checks = list(NEEDS) if checks is None else checks
    target = resolve_target(df, target)
    column_checks = [c for c in checks if c in COLUMN_CHECKS]
    parts = []
    if column_checks:
        facts = facts or gather_facts(df, target, set().union(*(NEEDS[c] for c in column_checks)), **limits)
        parts.append(column_findings(facts, column_checks, limits))
    if len(column_checks) < len(checks):
        parts.append(_table_findings(df, checks, k, facts))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gather_facts(df: DataFrame, target: str, need: set[str], **limits) -> Facts:
    k = LIMITS | limits
    return facts_mod.gather(
        df, target, need, rare_percent=k["rare_percent"], iqr_multiplier=k["iqr_multiplier"],
        outlier_min_values=max(3, k["outlier_min_values"]), exact_distinct=k["exact_distinct"],
    )


def ordered(found: DataFrame) -> DataFrame:
    """Severity, then category, then column."""
    return found.orderBy("severity_rank", "category", F.coalesce("column", F.lit("None")))


def penalties(found: DataFrame) -> DataFrame:
    """Penalty of each finding after the cap of its category, in finding order within the category."""
    base = F.create_map(*[F.lit(v) for kv in PENALTIES.items() for v in kv])[F.col("severity")]
    cap = F.create_map(*[F.lit(v) for kv in CATEGORY_CAPS.items() for v in kv])
    # One group holds the findings of one category, at most one per column.
    before = Window.partitionBy("category").orderBy("severity_rank", "column").rowsBetween(
        Window.unboundedPreceding, -1
    )
    spent = F.coalesce(F.sum("base").over(before), F.lit(0.0))
    limit = F.try_element_at(cap, F.col("category"))
    left = F.when(limit.isNull(), F.col("base")).otherwise(F.greatest(F.lit(0.0), limit - F.col("spent")))
    return (
        found.withColumn("base", base).withColumn("spent", spent)
        .withColumn("penalty", F.least("base", left)).where("penalty > 0")
        .select("category", "column", "severity", "penalty")
    )


def quality_score(found: DataFrame) -> DataFrame:
    """(score, health_label): 100 minus the capped penalties."""
    score = F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(F.sum("penalty"), F.lit(0.0)))
    label = "CASE WHEN score >= 90 THEN 'good' WHEN score >= 75 THEN 'needs_review' WHEN score >= 50 THEN 'poor' ELSE 'critical' END"
    return penalties(found).agg(F.round(score, 2).alias("score")).withColumn("health_label", F.expr(label))


def quality_warnings(found: DataFrame) -> DataFrame:
    """(position, warning) text per finding in finding order; one line when there is none."""
    text = F.concat(
        F.lit("["), F.upper("severity"), F.lit("] "), F.coalesce(F.concat("column", F.lit(": ")), F.lit("")),
        F.col("message"),
    )
    return _numbered(found, text, "warning", "No data-quality issue found.")


def recommended_actions(found: DataFrame) -> DataFrame:
    """(position, action): distinct recommendations in the order of the first finding that gives them."""
    return _numbered(found, F.col("recommendation"), "action", "No action needed.")


def _numbered(found: DataFrame, text, name: str, empty: str) -> DataFrame:
    # Findings are bounded by columns times checks, so one window over all of them is small.
    everything = Window.partitionBy(F.lit(0)).orderBy("severity_rank", "category", F.coalesce("column", F.lit("None")))
    placed = found.select(F.row_number().over(everything).alias("place"), text.alias(name))
    first = placed.groupBy(name).agg(F.min("place").alias("place"))
    numbered = first.select(
        F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("place")).cast("long").alias("position"), name
    )
    spare = small_table(found.sparkSession, [{"position": 1, name: empty}], {"position": "long", name: "string"})
    return numbered.unionByName(spare.join(numbered.limit(1).select("position"), "position", "left_anti"))


def column_quality(facts: Facts, found: DataFrame) -> DataFrame:
    """Missing and distinct counts of every column with the number of findings on it."""
    per_column = found.where("column IS NOT NULL").groupBy("column").agg(F.count(F.lit(1)).alias("finding_count"))
    return facts.table.join(per_column, "column", "left").select(
        "column", "dtype", "is_target", F.col("n_missing").alias("missing_count"), "missing_percent",
        F.col("n_distinct").alias("unique_count"), "unique_percent",
        F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
    )


def finding_summary(found: DataFrame) -> DataFrame:
    """(kind, name, findings, requires_human_review) by severity, by category and in total; severities keep zeros."""
    flags = [F.count("category").alias("findings"), F.coalesce(F.bool_or("requires_human_review"), F.lit(False)).alias("requires_human_review")]
    levels = small_table(found.sparkSession, [{"severity": s} for s in SEVERITIES], {"severity": "string"})
    by_severity = levels.join(found, "severity", "left").groupBy(F.col("severity").alias("name")).agg(*flags)
    by_category = found.groupBy(F.col("category").alias("name")).agg(*flags)
    total = found.agg(*flags).withColumn("name", F.lit("all"))
    parts = [t.select(F.lit(k).alias("kind"), "name", "findings", "requires_human_review")
             for k, t in (("severity", by_severity), ("category", by_category), ("total", total))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def missing_columns(facts: Facts, high: float = LIMITS["missing_high"]) -> DataFrame:
    """Columns with gaps, marking the empty ones and those above the high limit."""
    return facts.table.where("n_missing > 0").select(
        "column", F.col("n_missing").alias("missing_count"), "missing_percent",
        (F.col("n_missing") == F.col("n_rows")).alias("is_empty"), (F.col("missing_percent") >= high).alias("is_high_missing"),
    )


def target_quality(df: DataFrame, target: str, facts: Facts | None = None) -> DataFrame:
    """One row: type, gaps, distinct values, infinities and usable numbers of the target."""
    facts = facts or facts_mod.gather(df, target, {"frequency", "infinite"}, [target])
    numeric = F.col("type_group").isin("numeric", "boolean")
    return facts.table.where(F.col("column") == target).select(
        F.col("column").alias("target_column"), "dtype", F.col("n_missing").alias("missing_count"), "missing_percent",
        F.col("n_distinct").alias("unique_count"), "unique_percent", numeric.alias("is_numeric"),
        F.coalesce(F.col("pos_inf") + F.col("neg_inf"), F.lit(0)).alias("infinite_count"),
        F.when(numeric, F.coalesce("n_valid", "n_present")).alias("valid_numeric_count"),
        (F.col("n_distinct") < 2).alias("is_invalid"),
    )


def quality_audit(df: DataFrame, target: str, facts: Facts | None = None, **limits) -> dict[str, DataFrame]:
    """All quality tables of one (table, target) pair over one set of facts."""
    check_structure(df)
    target = resolve_target(df, target)
    require_features(df, target)
    facts = facts or gather_facts(df, target, set().union(*NEEDS.values()), **limits)
    rows = [r.asDict(recursive=True) for r in findings(df, target, None, facts, **limits).collect()]
    schema = FINDING_SCHEMA | {"severity_rank": "long", "requires_human_review": "boolean"}
    found = small_table(df.sparkSession, rows, schema)  # bounded by columns times checks
    return {
        "findings": ordered(found), "score": quality_score(found), "penalties": penalties(found),
        "warnings": quality_warnings(found), "actions": recommended_actions(found),
        "columns": column_quality(facts, found), "summary": finding_summary(found),
        "missing": missing_columns(facts), "target": target_quality(df, target, facts),
    }
