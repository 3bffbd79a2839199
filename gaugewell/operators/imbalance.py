"""Class distribution and imbalance of a classification target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugewell.errors import AuditError
from gaugewell.functions import cells
from gaugewell.functions.small import small_table
from gaugewell.operators.schema import columns_of, resolve_target

LOW_RATIO, MODERATE_RATIO, HIGH_RATIO, RARE_PERCENT = 1.5, 3.0, 10.0, 5.0
MANY_CLASSES = 20

# Metrics named for each problem type, for a low and for a higher imbalance.
METRICS = {
    ("binary_classification", True): ["Accuracy", "F1 Score", "ROC-AUC", "Confusion Matrix"],
    ("binary_classification", False): [
        "Precision", "Recall", "F1 Score", "PR-AUC", "ROC-AUC", "Balanced Accuracy", "Confusion Matrix",
    ],
    ("multiclass_classification", True): ["Accuracy", "Macro F1 Score", "Weighted F1 Score", "Confusion Matrix"],
    ("multiclass_classification", False): [
        "Macro Precision", "Macro Recall", "Macro F1 Score", "Weighted F1 Score", "Balanced Accuracy",
        "Per-class Recall", "Confusion Matrix",
    ],
}


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(class, cnt) of the labelled rows; one row per class after map-side counting."""
    info = columns_of(df, [target])[0]
    return df.groupBy(cells.text_key(target, info.dtype).alias("class")).agg(F.count(F.lit(1)).alias("cnt")).where(
        "class IS NOT NULL"
    )


def class_distribution(df: DataFrame, target: str, rare_percent: float = RARE_PERCENT) -> DataFrame:
    """(class, count, percent, is_majority, is_minority, is_rare); ties are all marked."""
    counts = class_counts(df, resolve_target(df, target))
    total, most, least = (counts.agg(f("cnt")).scalar() for f in (F.sum, F.max, F.min))
    return counts.select(
        "class", F.col("cnt").alias("count"), cells.percent(F.col("cnt"), total).alias("percent"),
        (F.col("cnt") == most).alias("is_majority"), (F.col("cnt") == least).alias("is_minority"),
    ).withColumn("is_rare", F.col("percent") < rare_percent)


def severity_of(ratio: Column, rare: Column) -> Column:
    """Rare classes decide between low and moderate below the moderate ratio."""
    return (
        F.when(ratio < MODERATE_RATIO, F.when(rare > 0, "moderate").otherwise("low"))
        .when(ratio < HIGH_RATIO, "high")
        .otherwise("severe")
    )


def imbalance_summary(df: DataFrame, target: str, problem_type: str, rare_percent: float = RARE_PERCENT) -> DataFrame:
    """One row with the ratio, severity, diversity measures and split viability; regression is not applicable.

    Entropy, Gini and effective classes use the percentages rounded to two places.
    """
    spark = df.sparkSession
    target = resolve_target(df, target)
    if problem_type == "regression":
        return small_table(
            spark, [{"target_column": target, "problem_type": problem_type, "is_applicable": False}],
            {"target_column": "string", "problem_type": "string", "is_applicable": "boolean"},
        )
    if (problem_type, True) not in METRICS:
        raise AuditError(f"Unsupported problem type: {problem_type}")
    counts = class_counts(df, target)
    total = counts.agg(F.sum("cnt")).scalar()
    p = F.round(F.col("cnt") * 100.0 / total.cast("double"), 2) / 100
    shares = counts.withColumn("p", p)
    k = F.count(F.lit(1))
    filled = F.count_if(F.col("p") > 0)
    entropy = -F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p"))) / F.log2(filled.cast("double"))
    squares = F.sum(F.col("p") * F.col("p"))
    out = shares.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("valid_target_rows"), k.alias("num_classes"),
        F.max("cnt").alias("majority_count"), F.min("cnt").alias("minority_count"),
        F.min(F.struct(-F.col("cnt"), F.col("class")))["class"].alias("majority_class"),
        F.min(F.struct("cnt", "class"))["class"].alias("minority_class"),
        F.count_if(F.col("p") * 100 < rare_percent).alias("rare_classes"),
        F.when(filled <= 1, 0.0).otherwise(F.round(entropy, 4)).alias("normalized_entropy"),
        F.round(F.greatest(F.lit(0.0), 1 - squares), 4).alias("gini_impurity"),
        F.when(squares > 0, F.round(1 / squares, 4)).otherwise(0.0).alias("effective_class_count"),
    )
    least = F.col("minority_count")
    ratio = F.round(F.col("majority_count") / least, 2)
    return (
        out.withColumn("imbalance_ratio", ratio)
        .withColumn("imbalance_severity", severity_of(F.col("imbalance_ratio"), F.col("rare_classes")))
        .withColumns({
            "target_column": F.lit(target), "problem_type": F.lit(problem_type), "is_applicable": F.lit(True),
            "can_stratify": least >= 2, "can_use_3_folds": least >= 3, "can_use_5_folds": least >= 5,
        })
    )


def imbalance_findings(summary: DataFrame) -> DataFrame:
    """(severity, category, message, requires_human_review) rows from an applicable summary."""
    arms = [
        ("imbalance_severity IN ('moderate', 'high', 'severe')", "imbalance_severity", "class_imbalance",
         "concat('The largest class is ', imbalance_ratio, ' times the smallest.')"),
        ("rare_classes > 0", "'medium'", "rare_classes", "concat(rare_classes, ' classes are rare.')"),
        ("minority_count < 2", "'critical'", "insufficient_class_samples", "'A class has fewer than 2 rows.'"),
        ("minority_count >= 2 AND minority_count < 5", "'high'", "very_small_minority_class", "'A class has fewer than 5 rows.'"),
    ]
    text = ", ".join(
        f"CASE WHEN {c} THEN named_struct('severity', {s}, 'category', '{k}', 'message', {m}, 'requires_human_review', true) END"
        for c, s, k, m in arms
    )
    return summary.select("target_column", F.inline(F.expr(f"array_compact(array({text}))")))


def recommended_metrics(summary: DataFrame) -> DataFrame:
    """(target_column, position, metric): rule table joined on problem type and severity."""
    rows = [
        {"problem_type": t, "low": low, "position": i + 1, "metric": m}
        for (t, low), metrics in METRICS.items() for i, m in enumerate(metrics)
    ]
    rules = small_table(
        summary.sparkSession, rows, {"problem_type": "string", "low": "boolean", "position": "long", "metric": "string"}
    )
    keyed = summary.withColumn("low", F.col("imbalance_severity") == "low")
    return keyed.join(F.broadcast(rules), ["problem_type", "low"]).select("target_column", "position", "metric")


def recommended_actions(summary: DataFrame) -> DataFrame:
    """(target_column, position, action) in fixed order."""
    skewed = "imbalance_severity IN ('moderate', 'high', 'severe')"
    strong = "imbalance_severity IN ('high', 'severe')"
    some = "NOT (imbalance_severity = 'low' AND rare_classes = 0)"
    arms = [
        (f"NOT ({some})", "No imbalance handling is needed."),
        (some, "Do not rely on accuracy alone."),
        (some, "Split train and test by class."),
        (some, "Read the confusion matrix and the recall of each class."),
        (skewed, "Compare macro and weighted metrics."),
        (skewed, "Try balanced class weights."),
        (strong, "Watch the recall of the smallest class."),
        (strong, "Resample only inside the training split."),
        ("rare_classes > 0", "Check whether rare classes are real labels."),
        (f"{some} AND minority_count < 2", "A class with one row cannot be split by class."),
        (f"{some} AND minority_count BETWEEN 2 AND 4", "A class under 5 rows makes scores unstable."),
        (f"{some} AND num_classes > {MANY_CLASSES}", "Many classes: check that they are not identifiers."),
    ]
    text = ", ".join(
        f"CASE WHEN {c} THEN named_struct('position', {i + 1}L, 'action', '{a}') END" for i, (c, a) in enumerate(arms)
    )
    return summary.select("target_column", F.inline(F.expr(f"array_compact(array({text}))")))


def imbalance_warning(summary: DataFrame) -> DataFrame:
    text = """CASE WHEN minority_count < 2 THEN 'A class has fewer than 2 rows; splitting by class can fail.'
        WHEN imbalance_severity = 'low' THEN 'No class imbalance.'
        WHEN imbalance_severity = 'moderate' THEN 'Moderate imbalance: accuracy can mislead.'
        WHEN imbalance_severity = 'high' THEN 'High imbalance: prefer F1, recall, precision, PR-AUC or balanced accuracy.'
        ELSE 'Severe imbalance: accuracy misleads and small classes may be ignored.' END"""
    return summary.select("target_column", F.expr(text).alias("warning"))


def imbalance_audit(df: DataFrame, target: str, problem_type: str) -> dict[str, DataFrame]:
    """All imbalance tables; a single-class target is an error."""
    summary = imbalance_summary(df, target, problem_type)
    if problem_type == "regression":
        return {"summary": summary}
    row = summary.first()
    if row["valid_target_rows"] == 0:
        raise AuditError("The target has no labelled rows.")
    if row["num_classes"] < 2:
        raise AuditError("The target needs at least two classes.")
    kept = df.sparkSession.createDataFrame([row], summary.schema)
    return {
        "summary": kept, "distribution": class_distribution(df, target), "findings": imbalance_findings(kept),
        "metrics": recommended_metrics(kept), "actions": recommended_actions(kept), "warning": imbalance_warning(kept),
    }
