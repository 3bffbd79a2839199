"""Scores of predictions, from counts that Spark aggregates."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from gaugewell.errors import TrainingError
from gaugewell.functions.small import small_table

CLASS_METRICS = ["accuracy", "balanced_accuracy", "precision_weighted", "recall_weighted", "f1_score", "f1_macro"]
BINARY_METRICS = ["precision_binary", "recall_binary", "f1_binary"]
REGRESSION_METRICS = ["mae", "mse", "rmse", "r2_score", "mape"]
LOWER_IS_BETTER = ["mae", "mse", "rmse", "mape"]

# Metric column a configured classification metric selects by.
SELECTION = {
    "f1": "f1_binary", "f1_binary": "f1_binary", "f1_score": "f1_score", "f1_weighted": "f1_score",
    "weighted_f1": "f1_score", "f1_macro": "f1_macro", "macro_f1": "f1_macro", "accuracy": "accuracy",
    "balanced_accuracy": "balanced_accuracy", "precision": "precision_binary", "precision_binary": "precision_binary",
    "precision_weighted": "precision_weighted", "recall": "recall_binary", "recall_binary": "recall_binary",
    "recall_weighted": "recall_weighted", "roc_auc": "roc_auc", "roc_auc_ovr_weighted": "roc_auc_ovr_weighted",
}

SCORES_PER_BUCKET = 200_000  # distinct scores one window group may order


def confusion(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, count) for the pairs that occur."""
    return predicted.groupBy(F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("prediction")).agg(
        F.count(F.lit(1)).alias("count"))


def confusion_matrix(predicted: DataFrame, classes: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per true class and one column per class, zeros filled."""
    pairs = confusion(predicted, label, prediction)
    rows = small_table(predicted.sparkSession, [{"label": c} for c in classes], {"label": "string"})
    wide = rows.join(pairs, "label", "left").groupBy("label").pivot("prediction", classes).agg(F.sum("count"))
    return wide.fillna(0)


def class_counts(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, support, predicted, hits) over classes in truth or prediction."""
    pairs = confusion(predicted, label, prediction)
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)
    truth = pairs.select(F.col("label").alias("class"), F.col("count").alias("support"), zero.alias("predicted"), hit.alias("hits"))
    guess = pairs.select(F.col("prediction").alias("class"), zero.alias("support"), F.col("count").alias("predicted"), zero.alias("hits"))
    return truth.unionByName(guess).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])


def classification_metrics(
    predicted: DataFrame, problem_type: str, label: str = "label", prediction: str = "prediction", positive: str | None = None
) -> DataFrame:
    """(metric, value) rounded to 4 places; a ratio over zero is 0. `positive` defaults to the last class in order."""
    counts = class_counts(predicted, label, prediction).withColumns({
        "recall": F.expr("if(support > 0, hits / support, 0D)"), "precision": F.expr("if(predicted > 0, hits / predicted, 0D)"),
    }).withColumn("f1", F.expr("if(precision + recall > 0, 2 * precision * recall / (precision + recall), 0D)"))
    n = F.sum("support")
    exprs = {
        "accuracy": F.sum("hits") / n, "balanced_accuracy": F.avg(F.expr("if(support > 0, recall, NULL)")),
        "precision_weighted": F.sum(F.col("precision") * F.col("support")) / n,
        "recall_weighted": F.sum(F.col("recall") * F.col("support")) / n,
        "f1_score": F.sum(F.col("f1") * F.col("support")) / n, "f1_macro": F.avg("f1"),
    }
    if problem_type == "binary_classification":
        two = F.count_if(F.col("support") > 0) <= 2
        for m in ("precision", "recall", "f1"):
            one = F.max_by(m, "class") if positive is None else F.max(F.when(F.col("class") == positive, F.col(m)))
            exprs[f"{m}_binary"] = F.when(two, F.coalesce(one, F.lit(0.0)))
    return _long(counts.agg(*[F.round(e, 4).alias(k) for k, e in exprs.items()]), list(exprs))


def _long(row: DataFrame, names: list[str]) -> DataFrame:
    return row.unpivot([], names, "metric", "value").where("value IS NOT NULL")


def roc_auc(scored: DataFrame) -> DataFrame:
    """(group, positives, negatives, auc) for (group, score, positive) rows, exact with half weight on ties.

    Scores are counted per distinct value first. The counts are cut into ordered
    buckets of bounded size; each bucket adds its own pairs plus its positives
    times the negatives of the buckets before it.
    """
    counts = scored.groupBy("group", F.col("score").cast("double").alias("score")).agg(
        F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n")).persist()
    distinct = counts.count()
    buckets = min(2000, max(1, math.ceil(distinct / SCORES_PER_BUCKET)))
    placed = counts.withColumn("bucket", F.lit(0.0))
    if buckets > 1:
        grid = [i / buckets for i in range(1, buckets)]
        cuts = sorted(set(counts.agg(F.percentile_approx("score", grid, 10_000).alias("c")).first()["c"]))
        splits = [-math.inf, *cuts, math.inf]
        placed = Bucketizer(splits=splits, inputCol="score", outputCol="bucket").transform(counts)
    inside = Window.partitionBy("group", "bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.col("p") * (F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("n") / 2)
    per_bucket = placed.withColumn("pairs", pairs).groupBy("group", "bucket").agg(
        F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("pairs").alias("pairs"))
    before = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = per_bucket.withColumn("pairs", F.col("pairs") + F.col("p").cast("double") * F.coalesce(F.sum("n").over(before), F.lit(0)))
    out = total.groupBy("group").agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum("pairs").alias("pairs"))
    area = F.expr("if(positives > 0 AND negatives > 0, pairs / (CAST(positives AS DOUBLE) * negatives), NULL)")
    rows = [r.asDict() for r in out.select(F.col("group").cast("string").alias("group"), "positives", "negatives", area.alias("auc")).collect()]
    counts.unpersist()
    return small_table(scored.sparkSession, rows, {"group": "string", "positives": "long", "negatives": "long", "auc": "double"})


def binary_auc(predicted: DataFrame, score: str, label: str, positive: str) -> DataFrame:
    """(metric, value) row roc_auc."""
    scored = predicted.select(F.lit("all").alias("group"), F.col(score).alias("score"), (F.col(label).cast("string") == positive).alias("positive"))
    return roc_auc(scored).where("auc IS NOT NULL").select(F.lit("roc_auc").alias("metric"), F.round("auc", 4).alias("value"))


def multiclass_auc(predicted: DataFrame, scores: str, label_index: str, n_classes: int) -> DataFrame:
    """One-versus-rest AUC weighted by class support. `scores` is an array with one entry per class index."""
    each = predicted.select(F.col(label_index).cast("int").alias("y"), F.posexplode(F.col(scores)).alias("group", "score"))
    scored = each.select("group", "score", (F.col("y") == F.col("group")).alias("positive"))
    table = roc_auc(scored)
    ok = F.count_if(F.col("auc").isNotNull()) == n_classes
    value = F.when(ok, F.round(F.sum(F.col("auc") * F.col("positives")) / F.sum("positives"), 4))
    return table.agg(value.alias("value")).where("value IS NOT NULL").select(F.lit("roc_auc_ovr_weighted").alias("metric"), "value")


def regression_metrics(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(metric, value) rounded to 4 places; MAPE over non-zero targets, in percent."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    err = y - p
    mse, spread = F.avg(err * err), F.var_pop(y)
    exprs = {
        "mae": F.avg(F.abs(err)), "mse": mse, "rmse": F.sqrt(mse),
        "r2_score": F.when(spread > 0, 1 - mse / spread).when(mse == 0, 1.0).otherwise(0.0),
        "mape": F.avg(F.when(y != 0, F.abs(err / y))) * 100,
    }
    return _long(predicted.agg(*[F.round(e, 4).alias(k) for k, e in exprs.items()]), list(exprs))


def selection_metric(problem_type: str, classification_default: str = "f1_weighted", regression_default: str = "rmse") -> tuple[str, bool]:
    """Metric column to select by and whether higher is better."""
    if problem_type == "regression":
        metric = regression_default if regression_default in REGRESSION_METRICS else "rmse"
        return metric, metric not in LOWER_IS_BETTER
    return SELECTION.get(classification_default, "f1_score"), True


def best_model(metrics: DataFrame, problem_type: str, **defaults) -> DataFrame:
    """One row with the best model of (position, model, metric, value); the first model wins ties.

    A classifier without the selection metric is judged by f1_score.
    """
    metric, higher = selection_metric(problem_type, **defaults)
    wanted = [metric] + (["f1_score"] if problem_type != "regression" else [])
    usable = metrics.where(F.col("metric").isin(wanted)).groupBy("position", "model").agg(
        F.coalesce(F.max(F.when(F.col("metric") == metric, F.col("value"))), F.max("value")).alias("score"))
    order = F.struct((-F.col("score") if higher else F.col("score")).alias("rank"), "position")
    return usable.agg(F.min_by("model", order).alias("model"), F.min_by("score", order).alias("score")).where("model IS NOT NULL").select(
        "model", F.lit(metric).alias("selection_metric"), "score", F.lit(higher).alias("higher_is_better"))


def leaderboard(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row per model, one column per metric."""
    return metrics.groupBy("position", "model").pivot("metric", names).agg(F.first("value"))


def require_rows(predicted: DataFrame) -> None:
    if predicted.isEmpty():
        raise TrainingError("There is nothing to evaluate.")
