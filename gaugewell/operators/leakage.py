"""Possible target leakage. Every risk is a hint for a person, never a confirmed leak."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType

from gaugewell.functions import cells, names
from gaugewell.functions.small import small_table
from gaugewell.operators import facts as facts_mod, stats
from gaugewell.operators.facts import Facts
from gaugewell.operators.neighbours import neighbour_information
from gaugewell.operators.schema import ColumnInfo, check_structure, columns_of, validate_target

# Risk levels in order.
LEVELS = ["critical", "high", "medium", "low"]

LIMITS = {
    "duplicate_share": 0.95, "correlation": 0.90, "correlation_high": 0.98, "mutual_information": 0.20,
    "separation": 0.75, "min_rows": 10, "max_classes": 50, "id_unique": 95.0, "cardinality": 50,
    "continuous_target": 20, "bins": 10, "estimator": "bins",
}

RISK_SCHEMA = {"column": "string", "risk_type": "string", "risk_level": "string", "reason": "string", "evidence": "map"}


def _risk_rows(table: DataFrame, risk_type: Column | str, level: Column | str, reason: str, evidence: list[str]) -> DataFrame:
    """Give a table with one row per flagged column the common risk shape."""
    pairs = [x for e in evidence for x in (F.lit(e), F.col(e).cast("string"))]
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    return table.select(
        "column", as_column(risk_type).alias("risk_type"), as_column(level).alias("risk_level"),
        F.lit(reason).alias("reason"), F.create_map(*pairs).alias("evidence"),
    )


def _features(df: DataFrame, target: str, group: str | None = None) -> list[ColumnInfo]:
    return [c for c in columns_of(df) if c.name != target and (group is None or c.group == group)]


def name_relations(pairs: DataFrame) -> DataFrame:
    """Name evidence for any table of (column, target) pairs, so many targets can be checked together."""
    return pairs.withColumns({
        "matched_keywords": names.outcome_words(F.col("column")),
        "target_name_overlap": names.shares_token(F.col("column"), F.col("target")),
        "explicit_target_relation": names.names_target(F.col("column"), F.col("target")),
    }).where((F.size("matched_keywords") > 0) | F.col("target_name_overlap") | F.col("explicit_target_relation"))


def name_risks(df: DataFrame, target: str) -> DataFrame:
    rows = [{"column": c.name, "target": target} for c in _features(df, target)]
    pairs = small_table(df.sparkSession, rows, {"column": "string", "target": "string"})
    level = F.when(F.col("explicit_target_relation"), "high").otherwise("medium")
    flagged = name_relations(pairs).withColumn("matched_keywords", F.array_join("matched_keywords", ","))
    return _risk_rows(
        flagged, "name_based_risk", level, "The column name points at the target.",
        ["matched_keywords", "target_name_overlap", "explicit_target_relation"],
    )


def _comparable(feature: ColumnInfo, target: ColumnInfo) -> tuple[Column, Column]:
    """Both cells as text; numbers as numbers, so that 1 and 1.0 agree, and as doubles only where one side is floating."""
    if feature.group == target.group == "numeric":
        a, b = cells.present(feature.name, feature.dtype), cells.present(target.name, target.dtype)
        floating = cells.is_float(feature.dtype) or cells.is_float(target.dtype)
        return (a.cast("double"), b.cast("double")) if floating else (a, b)
    return cells.text(feature.name, feature.dtype), cells.text(target.name, target.dtype)


def _as_number(text: Column, dtype: DataType) -> Column:
    """The number that is written as this text, null where there is none (`07` or ` 7` are no numbers written so).

    Only texts that begin with a code from + to 9, or with the I of Infinity, are parsed, as a failing cast is slow.
    """
    first = F.ascii(text)
    x = F.when(first.between(43, 57) | (first == 73), text.try_cast(dtype))
    x = x + F.lit(0.0).cast(dtype) if cells.is_float(dtype) else x
    return F.when(x.cast("string") == text, x)


def duplicate_target_stats(df: DataFrame, target: str) -> DataFrame:
    """(column, compared_rows, equal_rows, rows) for every feature, in one pass.

    A text target is read as a number once a row and compared with the numbers, instead of writing every number as text.
    """
    t = columns_of(df, [target])[0]
    exprs, features = {}, _features(df, target)
    label = cells.text(target, t.dtype)
    kinds = list({c.dtype.simpleString(): c.dtype for c in features if c.group == "numeric"}.items()) if t.group == "categorical" else []
    read = {kind: f"__target_as_{i}" for i, (kind, _) in enumerate(kinds)}
    source = df.select("*", *[_as_number(label, dtype).alias(read[kind]) for kind, dtype in kinds])
    for c in features:
        if c.group == "numeric" and read:
            x = cells.present(c.name, c.dtype)
            exprs[c.name] = F.when(x.isNotNull() & label.isNotNull(), F.coalesce(x == F.col(read[c.dtype.simpleString()]), F.lit(False)))
        else:
            a, b = _comparable(c, t)
            exprs[c.name] = a == b  # null when either side is missing
    found = stats.reduce_cells(source, exprs, {"compared_rows": "count(x)", "equal_rows": "count_if(x)", "rows": "count(1)"})
    rows = [{"column": n} | e for n, e in found.items()]
    return small_table(
        df.sparkSession, rows, {"column": "string", "compared_rows": "long", "equal_rows": "long", "rows": "long"}
    )


def duplicate_target_risks(df: DataFrame, target: str, **limits) -> DataFrame:
    k = LIMITS | limits
    ratio = F.col("equal_rows") / F.col("compared_rows")
    flagged = (
        duplicate_target_stats(df, target).where(F.col("compared_rows") >= max(1, k["min_rows"]))
        .withColumn("ratio", ratio).where(F.col("ratio") >= k["duplicate_share"])
        .withColumns({
            "same_values_ratio": F.round("ratio", 4),
            "coverage_percent": cells.percent(F.col("compared_rows"), F.col("rows")),
        })
    )
    return _risk_rows(
        flagged, "duplicate_target_risk", "critical", "The column equals the target on almost all rows.",
        ["same_values_ratio", "compared_rows", "coverage_percent"],
    )


def correlations(df: DataFrame, target: str) -> DataFrame:
    """(column, compared_rows, correlation) of numeric features with a numeric target over finite pairs."""
    t = columns_of(df, [target])[0]
    schema = {"column": "string", "compared_rows": "long", "correlation": "double"}
    if t.group != "numeric":
        return small_table(df.sparkSession, [], schema)
    y = cells.finite(target, t.dtype)
    exprs = {}
    for c in _features(df, target, "numeric"):
        x = cells.finite(c.name, c.dtype)
        exprs[c.name] = F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("a"), y.alias("b")))
    aggs = {
        "compared_rows": "count(x)", "r": "corr(x.a, x.b)", "a_lo": "min(x.a)", "a_hi": "max(x.a)",
        "b_lo": "min(x.b)", "b_hi": "max(x.b)",
    }
    rows = []
    for name, e in stats.reduce_cells(df, exprs, aggs).items():
        varies = e["compared_rows"] and e["a_lo"] != e["a_hi"] and e["b_lo"] != e["b_hi"]
        r = e["r"] if varies and e["r"] is not None and e["r"] == e["r"] else None
        rows.append({"column": name, "compared_rows": e["compared_rows"], "correlation": r})
    return small_table(df.sparkSession, rows, schema)


def correlation_risks(df: DataFrame, target: str, **limits) -> DataFrame:
    k = LIMITS | limits
    size = F.abs("correlation")
    flagged = (
        correlations(df, target).where((F.col("compared_rows") >= k["min_rows"]) & (size >= k["correlation"]))
        .withColumns({"correlation_with_target": F.round("correlation", 4), "absolute_correlation": F.round(size, 4)})
    )
    level = F.when(size >= k["correlation_high"], "high").otherwise("medium")
    return _risk_rows(
        flagged, "high_correlation_risk", level, "The column is almost a linear function of the target.",
        ["correlation_with_target", "absolute_correlation", "compared_rows"],
    )


def filled_numeric(df: DataFrame, columns: list[str], medians: dict[str, float] | None = None) -> DataFrame:
    """Numeric columns with gaps and infinities set to the exact median; constant columns are dropped."""
    infos = [c for c in columns_of(df, columns) if c.group == "numeric"]
    if medians is None:
        medians, _, _ = stats.filled_quantiles(df, columns, [])
    kept = [F.coalesce(cells.finite(c.name, c.dtype), F.lit(medians[c.name])).alias(c.name) for c in infos if c.name in medians]
    others = [cells.qcol(n) for n in df.columns if n not in set(columns)]
    return df.select(*others, *kept)


def _bins(name: str, cuts: list[float]) -> Column:
    """Number of cut points below the value."""
    quoted = "`" + name.replace("`", "``") + "`"
    arms = [f"WHEN {quoted} <= {c!r}D THEN {i}" for i, c in enumerate(sorted(set(cuts)))]
    return F.expr(f"CASE {' '.join(arms)} ELSE {len(arms)} END")


def mutual_information(df: DataFrame, target: str, bins: int = LIMITS["bins"], continuous: int = LIMITS["continuous_target"]) -> DataFrame:
    """(column, mutual_information, rows_used, target_kind) in nats, over all labelled rows.

    Plug-in estimate on exact quantile bins, less its bias for independent variables: (bins - 1)(classes - 1) / (2 rows), of
    those that occur; never below zero. A numeric target with more than
    `continuous` distinct values is binned as well. The estimator differs from a
    nearest-neighbour one, the rule on top of it is the same.
    """
    t = columns_of(df, [target])[0]
    schema = {"column": "string", "mutual_information": "double", "rows_used": "long", "target_kind": "string"}
    spark = df.sparkSession
    features = [c.name for c in _features(df, target, "numeric")]
    if not features:
        return small_table(spark, [], schema)
    labelled = df.where(cells.present(target, t.dtype).isNotNull())
    probs = [i / bins for i in range(1, bins)]
    kind, label = "classification", cells.text_key(target, t.dtype)
    if t.group == "numeric":
        distinct = labelled.agg(F.approx_count_distinct(cells.finite(target, t.dtype)).alias("n")).first()["n"]
        if distinct <= 4 * continuous:  # near the limit: count exactly, the set is small
            distinct = labelled.agg(F.count_distinct(cells.present(target, t.dtype)).alias("n")).first()["n"]
        if distinct > continuous:
            kind = "numeric"
    wanted = features + ([target] if kind == "numeric" else [])
    medians, cuts, _ = stats.filled_quantiles(labelled, wanted, probs, unfilled=[target])
    kept = [n for n in features if n in medians]
    if not kept:
        return small_table(spark, [], schema)
    filled = filled_numeric(labelled, features, medians)
    if kind == "numeric":
        filled = filled.withColumn("__y", F.coalesce(cells.finite(target, t.dtype), F.lit(medians[target])))
        label = _bins("__y", cuts[target]).cast("string")
    binned = filled.select(label.alias("y"), *[_bins(n, cuts[n]).alias(f"b{i}") for i, n in enumerate(kept)])
    joint = (
        binned.unpivot(["y"], [f"b{i}" for i in range(len(kept))], "pos", "bin")
        .groupBy("pos", "bin", "y").agg(F.count(F.lit(1)).alias("c"))
    )
    # H(x) + H(y) - H(x, y) from sums of c*ln(c). Every feature sees all rows, so the joint counts of the first one give the class counts.
    plogp = lambda c: F.sum(F.col(c) * F.ln(c))
    sides = joint.withColumn("of_class", F.when(F.col("pos") == "b0", F.col("c"))).groupingSets([["pos", "bin"], ["y"]], "pos", "bin", "y").agg(
        F.sum("c").alias("cx"), plogp("c").alias("sxy"), F.sum("of_class").alias("cy"))
    rows = {
        r["pos"]: r for r in sides.groupBy("pos").agg(
            F.sum("cx").alias("n"), plogp("cx").alias("sx"), F.sum("sxy").alias("sxy"), plogp("cy").alias("sy"), F.count(F.lit(1)).alias("groups")).collect()
    }  # one row per feature, and one for the classes
    if not rows:
        return small_table(spark, [], schema)
    sy, n_classes = rows[None]["sy"], rows[None]["groups"]
    out = []
    for i, name in enumerate(kept):
        r = rows[f"b{i}"]
        score = math.log(r["n"]) + (r["sxy"] - r["sx"] - sy) / r["n"] - (r["groups"] - 1) * (n_classes - 1) / (2 * r["n"])
        out.append({"column": name, "mutual_information": max(0.0, score), "rows_used": r["n"], "target_kind": kind})
    return small_table(spark, out, schema)


def mutual_information_risks(df: DataFrame, target: str, **limits) -> DataFrame:
    """Features that tell at least `mutual_information` nats; with estimator="neighbours" a class target is judged by nearest neighbours."""
    k = LIMITS | limits
    classes = columns_of(df, [target])[0].group != "numeric"
    scores = neighbour_information(df, target) if k["estimator"] == "neighbours" and classes else mutual_information(df, target, k["bins"], k["continuous_target"])
    flagged = scores.where(F.col("mutual_information") >= k["mutual_information"]).withColumn("mutual_information", F.round("mutual_information", 4))
    kind = F.concat("target_kind", F.lit("_target_mutual_information_risk"))
    return _risk_rows(
        flagged, kind, "medium", "The column tells much about the target.", ["mutual_information", "rows_used"]
    )


def class_means(df: DataFrame, target: str, max_classes: int = LIMITS["max_classes"]) -> DataFrame:
    """(column, class, class_mean, class_count) over finite feature cells; empty outside 2..max_classes classes."""
    t = columns_of(df, [target])[0]
    schema = {"column": "string", "class": "string", "class_mean": "double", "class_count": "long"}
    features = [c for c in _features(df, target, "numeric")]
    label = cells.text_key(target, t.dtype)
    classes = df.select(label.alias("class")).where("class IS NOT NULL").groupBy("class").agg(F.lit(1).alias("one"))
    k = classes.limit(max_classes + 1).count()
    if not features or not 2 <= k <= max_classes:
        return small_table(df.sparkSession, [], schema)
    aggs = []
    for i, c in enumerate(features):
        x = cells.finite(c.name, c.dtype)
        aggs += [F.avg(x).alias(f"m{i}"), F.count(x).alias(f"n{i}")]
    # Wide in features, one row per class: nothing is multiplied and the shuffle holds partial sums only.
    wide = df.where(label.isNotNull()).groupBy(label.alias("class")).agg(*aggs)
    parts = ", ".join(f"named_struct('i', {i}, 'class_mean', m{i}, 'class_count', n{i})" for i in range(len(features)))
    listed = F.array(*[F.lit(c.name) for c in features])
    return (
        wide.select("class", F.inline(F.expr(f"array({parts})"))).where("class_count > 0")
        .select(F.element_at(listed, F.col("i") + 1).alias("column"), "class", "class_mean", "class_count")
    )


def separation(df: DataFrame, target: str, **limits) -> DataFrame:
    """(column, separation_ratio, compared_rows, class_means, class_counts) for comparable features."""
    k = LIMITS | limits
    hi, lo = F.max("class_mean"), F.min("class_mean")
    scale = F.greatest(F.abs(hi), F.abs(lo), F.lit(1e-9))
    means = F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", F.round("class_mean", 4)))))
    counts = F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "class_count"))))
    return (
        class_means(df, target, k["max_classes"]).groupBy("column").agg(  # at most max_classes rows per group
            F.count(F.lit(1)).alias("classes"), F.min("class_count").alias("least"),
            F.sum("class_count").alias("compared_rows"), (F.abs(hi - lo) / scale).alias("separation_ratio"),
            F.to_json(means).alias("class_means"), F.to_json(counts).alias("class_counts"),
        )
        .where(f"classes >= 2 AND least >= 2 AND compared_rows >= {k['min_rows']}").drop("classes", "least")
    )


def separation_risks(df: DataFrame, target: str, **limits) -> DataFrame:
    k = LIMITS | limits
    flagged = separation(df, target, **limits).where(F.col("separation_ratio") >= k["separation"]).withColumn(
        "separation_ratio", F.round("separation_ratio", 4)
    )
    return _risk_rows(
        flagged, "target_proxy_separation_risk", "medium", "The class means of the column lie far apart.",
        ["separation_ratio", "class_means", "class_counts", "compared_rows"],
    )


def _identifier_candidates(df: DataFrame, target: str) -> list[str]:
    """Features that can be flagged as identifiers: texts, by their distinct values, and any whose name says so."""
    features = _features(df, target)
    named = small_table(df.sparkSession, [{"column": c.name} for c in features], {"column": "string"}).where(names.looks_like_id(F.col("column"), names.ID_WORDS))
    by_name = {r["column"] for r in named.collect()}
    return [c.name for c in features if c.group == "categorical" or c.name in by_name]


def identifier_risks(df: DataFrame, target: str, facts: Facts | None = None, **limits) -> DataFrame:
    k = LIMITS | limits
    facts = facts or facts_mod.gather(df, target, {"frequency"}, _identifier_candidates(df, target))
    flagged = facts.table.where("NOT is_target").withColumns({
        "name_suggests_identifier": names.looks_like_id(F.col("column"), names.ID_WORDS),
        "uniqueness_suggests_identifier": (F.col("type_group") == "categorical")
        & (F.col("n_distinct") >= k["cardinality"]) & (F.col("unique_percent") >= k["id_unique"]),
    }).where("name_suggests_identifier OR uniqueness_suggests_identifier")
    level = F.when(F.col("name_suggests_identifier"), "medium").otherwise("low")
    return _risk_rows(
        flagged, "high_cardinality_identifier_risk", level, "The column looks like an identifier.",
        ["n_distinct", "unique_percent", "name_suggests_identifier", "uniqueness_suggests_identifier"],
    )


def _ranked(risks: DataFrame) -> DataFrame:
    levels = ", ".join(f"'{v}'" for v in LEVELS)
    return risks.withColumns({
        "level_rank": F.expr(f"CAST(array_position(array({levels}), risk_level) - 1 AS BIGINT)"),
        "is_confirmed_leakage": F.lit(False), "requires_human_review": F.lit(True),
    })


def risks(df: DataFrame, target: str, facts: Facts | None = None, **limits) -> DataFrame:
    """All risks of one target: name, duplicate, correlation, mutual information, separation, identifier."""
    target = validate_target(df, target)
    parts = [
        name_risks(df, target), duplicate_target_risks(df, target, **limits), correlation_risks(df, target, **limits),
        mutual_information_risks(df, target, **limits), separation_risks(df, target, **limits),
        identifier_risks(df, target, facts, **limits),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _ranked(out)


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("level_rank", "column", "risk_type")


def risk_summary(found: DataFrame) -> DataFrame:
    """(kind, name, risks): counts by level (zeros kept) and by type."""
    levels = small_table(found.sparkSession, [{"risk_level": v} for v in LEVELS], {"risk_level": "string"})
    by_level = levels.join(found, "risk_level", "left").groupBy(F.col("risk_level").alias("name")).agg(
        F.count("column").alias("risks")
    )
    by_type = found.groupBy(F.col("risk_type").alias("name")).agg(F.count(F.lit(1)).alias("risks"))
    return by_level.select(F.lit("level").alias("kind"), "name", "risks").unionByName(
        by_type.select(F.lit("type").alias("kind"), "name", "risks")
    )


def overall(found: DataFrame) -> DataFrame:
    """(total_risks, overall_severity), with none when there is no risk."""
    return found.agg(
        F.count(F.lit(1)).alias("total_risks"),
        F.coalesce(F.min_by("risk_level", "level_rank"), F.lit("none")).alias("overall_severity"),
    )


def review_columns(found: DataFrame) -> DataFrame:
    """One row per flagged column: highest level, its distinct risk types and their number."""
    return found.groupBy("column").agg(
        F.min_by("risk_level", "level_rank").alias("highest_risk_level"),
        F.array_join(F.sort_array(F.collect_set("risk_type")), ",").alias("risk_types"),  # at most seven types
        F.count(F.lit(1)).alias("risk_count"),
    ).withColumn("requires_human_review", F.lit(True))


def recommended_actions(found: DataFrame) -> DataFrame:
    """(position, action): rule table kept where one of its risk types is present."""
    always = [
        "Check that flagged columns are known at prediction time.", "Remove columns derived from the target.",
        "Compare scores with and without the flagged columns.", "Write down the decision on every risk.",
    ]
    special = [
        ("duplicate_target_risk", 0, "Review columns that repeat the target first."),
        ("high_correlation_risk", 10, "Look for formulas behind highly correlated columns."),
        ("classification_target_mutual_information_risk", 11, "Review columns with high mutual information."),
        ("numeric_target_mutual_information_risk", 11, "Review columns with high mutual information."),
        ("high_cardinality_identifier_risk", 12, "Drop or review identifiers before encoding."),
    ]
    spark, schema = found.sparkSession, {"risk_type": "string", "position": "long", "action": "string"}
    rules = small_table(spark, [{"risk_type": t, "position": p, "action": a} for t, p, a in special], schema)
    present = rules.join(found.select("risk_type"), "risk_type", "left_semi").select("position", "action").distinct()
    base = small_table(
        spark, [{"position": i + 1, "action": a, "one": 1} for i, a in enumerate(always)],
        {"position": "long", "action": "string", "one": "int"},
    )
    some = found.limit(1).select(F.lit(1).alias("one"))
    none = small_table(
        spark, [{"position": 1, "action": "No leakage hint was found.", "one": 1}],
        {"position": "long", "action": "string", "one": "int"},
    )
    return (
        present.unionByName(base.join(some, "one", "left_semi").drop("one"))
        .unionByName(none.join(some, "one", "left_anti").drop("one"))
    )


def warning_text(total: int) -> str:
    if total == 0:
        return "No leakage hint was found; this does not prove that there is no leakage."
    return "Possible leakage, not confirmed: check whether the flagged columns are known at prediction time."


def leakage_check(df: DataFrame, target: str, facts: Facts | None = None, **limits) -> dict[str, Any]:
    """All leakage tables of one (table, target) pair."""
    check_structure(df)
    rows = [r.asDict(recursive=True) for r in risks(df, target, facts, **limits).collect()]
    schema = RISK_SCHEMA | {"level_rank": "long", "is_confirmed_leakage": "boolean", "requires_human_review": "boolean"}
    found = small_table(df.sparkSession, rows, schema)  # bounded by columns times risk types
    return {
        "risks": ordered(found), "summary": risk_summary(found), "overall": overall(found),
        "review_columns": review_columns(found), "actions": recommended_actions(found),
        "warning": warning_text(len(rows)),
    }
