"""Problem type of a target column, or of many columns at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugewell.errors import AuditError
from gaugewell.functions import cells
from gaugewell.operators import facts as facts_mod, profile
from gaugewell.operators.facts import Facts
from gaugewell.operators.schema import resolve_target

MAX_CLASSES_NUMERIC = 20
HIGH_CARDINALITY = 50
LOW_UNIQUE_PERCENT = 2.0
HIGH_UNIQUE_PERCENT = 80.0
INTEGER_REVIEW_LIMIT = 50
PREVIEW_CLASSES = 15


def target_stats(df: DataFrame, columns: list[str], facts: Facts | None = None) -> DataFrame:
    """Diagnostics of each named column as a target."""
    facts = facts or facts_mod.gather(df, None, {"labels", "frequency"}, columns)
    return facts.table.where(F.col("column").isin(columns)).select(
        F.col("column").alias("target_column"), F.col("dtype").alias("target_dtype"),
        F.col("type_group").isin("numeric", "boolean").alias("is_numeric"),
        (F.col("type_group") == "boolean").alias("is_bool"), F.col("bool_like").alias("is_bool_like"),
        (F.col("int_like") & F.col("type_group").isin("numeric", "boolean")).alias("is_integer_like"),
        F.col("n_distinct").alias("unique_values"),
        cells.percent(F.col("n_distinct"), F.col("n_present")).alias("unique_percent"),
        F.col("n_present").alias("total_values"), F.col("n_rows").alias("total_rows"),
        F.col("n_missing").alias("missing_count"), "missing_percent",
    )


def infer_types(
    stats: DataFrame, max_classes: int = MAX_CLASSES_NUMERIC, high_cardinality: int = HIGH_CARDINALITY,
    low_unique_percent: float = LOW_UNIQUE_PERCENT,
) -> DataFrame:
    """Add problem_type, confidence, needs_human_review and the reasons. The first matching case wins."""
    if max_classes < 2:
        raise AuditError("The class limit must be at least 2.")
    case = F.expr(
        f"""CASE WHEN total_values = 0 OR unique_values < 2 THEN 'invalid'
                 WHEN unique_values = 2 OR is_bool_like THEN 'two_values'
                 WHEN NOT is_numeric THEN 'labels'
                 WHEN unique_values <= {max_classes} THEN 'few_numbers'
                 WHEN is_integer_like AND unique_percent <= {low_unique_percent} THEN 'repeated_integers'
                 WHEN is_integer_like AND unique_values <= {INTEGER_REVIEW_LIMIT} THEN 'some_integers'
                 ELSE 'continuous' END"""
    )
    outcome = {
        "problem_type": """CASE case WHEN 'invalid' THEN 'invalid_target' WHEN 'two_values' THEN 'binary_classification'
            WHEN 'labels' THEN 'multiclass_classification' WHEN 'few_numbers' THEN 'multiclass_classification'
            ELSE 'regression' END""",
        "confidence": f"""CASE WHEN case = 'two_values' THEN if(is_bool_like, 'high', 'medium')
            WHEN case = 'labels' THEN if(unique_values > {high_cardinality}, 'medium', 'high')
            WHEN case = 'continuous' THEN 'high' WHEN case = 'invalid' THEN 'none' ELSE 'medium' END""",
        "needs_human_review": f"""CASE case WHEN 'two_values' THEN NOT is_bool_like AND is_numeric
            WHEN 'labels' THEN unique_values > {high_cardinality}
            WHEN 'continuous' THEN false ELSE true END""",
    }
    reasons = {
        "human_review_reason": """CASE WHEN NOT needs_human_review AND NOT (case = 'two_values' AND NOT is_bool_like) THEN NULL
            WHEN case = 'two_values' THEN 'Two values: confirm what each label stands for.'
            WHEN case = 'labels' THEN 'Many text labels: check that the target is not an identifier.'
            WHEN case = 'few_numbers' THEN 'Few distinct numbers: classes, ratings or a measured quantity.'
            WHEN case = 'invalid' THEN 'The column has fewer than two distinct values.'
            ELSE 'Integer target with repeated values: measured quantity or ordered classes.' END""",
        "reason": f"""CASE WHEN case = 'invalid' THEN 'Fewer than two distinct values.'
            WHEN case = 'two_values' THEN concat('Two distinct values', if(is_bool_like, ' that read as yes or no', ''), '.')
            WHEN case = 'labels' THEN concat(unique_values, ' distinct text labels.')
            WHEN case = 'few_numbers' THEN concat(unique_values, ' distinct numbers, at most {max_classes}.')
            ELSE concat(unique_values, ' distinct numbers (', unique_percent, '% of the values)',
                        if(is_integer_like, ', all integers', ''), '.') END""",
        "recommended_action": """CASE WHEN case = 'invalid' THEN 'Choose another target.'
            WHEN needs_human_review THEN 'Confirm the problem type before training.'
            WHEN problem_type = 'regression' THEN 'Look at the target distribution, then use regression metrics.'
            ELSE 'Check class balance, then split by class and use classification metrics.' END""",
    }
    out = stats.withColumn("case", case)
    out = out.withColumns({k: F.expr(v) for k, v in outcome.items()})
    return out.withColumns({k: F.expr(v) for k, v in reasons.items()}).drop("case")


def problem_types(df: DataFrame, columns: list[str], facts: Facts | None = None, **limits) -> DataFrame:
    """Problem type of every named column taken as the target."""
    return infer_types(target_stats(df, columns, facts), **limits)


def detect(df: DataFrame, target: str, facts: Facts | None = None, **limits) -> DataFrame:
    """Problem type of one target; an unusable target is an error."""
    name = resolve_target(df, target)
    out = problem_types(df, [name], facts, **limits)
    row = out.first()
    if row["total_values"] == 0:
        raise AuditError(f"Target column '{name}' has only missing values.")
    if row["problem_type"] == "invalid_target":
        raise AuditError(f"Target column '{name}' has only one distinct value.")
    return out


def warnings(
    types: DataFrame, high_cardinality: int = HIGH_CARDINALITY, high_unique_percent: float = HIGH_UNIQUE_PERCENT
) -> DataFrame:
    """(target_column, warning, message): one row per rule that applies to a typed target."""
    classes = "problem_type IN ('binary_classification', 'multiclass_classification')"
    rules = [
        ("total_rows < 50", "few_rows", "'Fewer than 50 rows: the problem type may be wrong.'"),
        ("missing_percent > 0", "missing_target", "concat(missing_percent, '% of the target is missing; drop those rows.')"),
        ("needs_human_review", "needs_review", "'The target is ambiguous and needs a review.'"),
        (f"{classes} AND unique_values > {high_cardinality}", "high_cardinality", "'Many classes: check that they are not identifiers.'"),
        ("is_numeric AND is_integer_like AND unique_values BETWEEN 5 AND 50", "integer_levels", "'Integer target with few levels: ordered classes or a quantity.'"),
        ("is_bool_like AND problem_type = 'binary_classification'", "positive_class", "'Confirm which label is the positive class.'"),
        (f"{classes} AND unique_percent > {high_unique_percent}", "mostly_unique", "'Most labels occur once: this may not be a classification target.'"),
        ("total_values = 0", "no_values", "'The target has no values.'"),
    ]
    arms = [f"CASE WHEN {c} THEN named_struct('warning', '{k}', 'message', {m}) END" for c, k, m in rules]
    return types.select("target_column", F.inline(F.expr(f"array_compact(array({', '.join(arms)}))")))


def class_preview(df: DataFrame, target: str, k: int = PREVIEW_CLASSES) -> DataFrame:
    """The k largest classes with their share of the labelled rows."""
    labelled = df.where(cells.present(target, df.schema[target].dataType).isNotNull())
    return profile.top_values(labelled, [target], k).withColumnRenamed("value", "class").drop("column")
