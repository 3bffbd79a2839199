"""Writers: JSON-safe and spreadsheet-safe exports, reports and the run log."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugewell.errors import AuditError
from gaugewell.functions import cells
from gaugewell.functions.small import small_table

# Longest key and parameter value of a run log.
MAX_KEY, MAX_VALUE, CUT_MARK = 250, 500, "...[truncated]"


def json_rows(df: DataFrame) -> DataFrame:
    """(value) one JSON document per row, NaN and infinities as null."""
    safe = df.select(*[cells.json_safe(f.name, f.dataType) for f in df.schema.fields])
    return safe.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def csv_rows(df: DataFrame) -> DataFrame:
    """String cells that a spreadsheet would run as a formula get a leading quote."""
    return df.select(*[cells.csv_safe(f.name, f.dataType) for f in df.schema.fields])


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    json_rows(df).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    flat = [
        F.to_json(cells.qcol(f.name)).alias(f.name) if cells.type_group(f.dataType) == "unsupported" else cells.qcol(f.name)
        for f in df.schema.fields
    ]
    csv_rows(df.select(*flat)).write.mode(mode).option("header", True).csv(path)


def write_report(tables: dict[str, DataFrame], markdown: DataFrame, path: str, mode: str = "error") -> None:
    """Result tables as parquet and reports as text, one folder per table under `path`."""
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{path}/{name}")
    markdown.select("report").write.mode(mode).option("lineSep", "\n\n").text(f"{path}/markdown")
    body = F.concat(F.lit("<html><body><pre>"), _escape(F.col("report")), F.lit("</pre></body></html>"))
    markdown.select(body.alias("value")).write.mode(mode).text(f"{path}/html")


def _escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def metric_name(name: Column) -> Column:
    """Lower case, blanks, dashes and slashes as underscores, brackets gone, other signs as one underscore."""
    key = F.translate(F.trim(F.lower(name)), " -/()", "___")
    key = F.regexp_replace(F.regexp_replace(key, "[^a-zA-Z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.substring(F.when(key != "", key).otherwise("metric"), 1, MAX_KEY)


def param_name(name: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.trim(name), "[^a-zA-Z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.substring(F.when(key != "", key).otherwise("param"), 1, MAX_KEY)


def param_value(value: Column) -> Column:
    """Whole numbers without a fraction, long texts cut with a mark."""
    whole = F.regexp_replace(value, r"^([+-]?[0-9]+)\.0+$", "$1")
    cut = F.concat(F.substring(value, 1, MAX_VALUE - 15), F.lit(CUT_MARK))
    return F.when(F.length(value) > MAX_VALUE, cut).otherwise(whole)


def run_log(baseline, run_id: str | None = None) -> dict[str, DataFrame]:
    """`runs` (run_id, parent_id, model, param, value) and `metrics` (run_id, key, value) of a baseline result.

    One parent run with a child per model.
    """
    parent = run_id or uuid.uuid4().hex
    spark = baseline.metrics.sparkSession
    rows = [r.asDict() for r in baseline.metrics.collect()]  # models times metrics
    if not rows:
        raise AuditError("There is no baseline result to log.")
    details, best = baseline.details.first().asDict(), baseline.best.first().asDict()
    names = list(dict.fromkeys(r["model"] for r in rows))
    child = {m: f"{parent}-{i}" for i, m in enumerate(names)}
    common = {
        "run_type": "baseline_experiment_parent", "problem_type": baseline.problem_type, "target_column": baseline.target,
        "models_count": len(names), "models_trained": ", ".join(names), "cross_validation_enabled": details["cross_validation_enabled"],
        "requested_cv_folds": details["requested_folds"], "actual_cv_folds": details["actual_folds"], "test_size": details["test_size"],
        "random_state": details["seed"], "best_model_name": best["model"], "selection_metric": best["selection_metric"],
    }
    g = baseline.groups
    prepared = {
        "run_type": "baseline_model", "numeric_columns_count": len(g.numeric), "categorical_columns_count": len(g.categorical),
        "datetime_columns_count": len(g.datetime), "unsupported_columns_dropped_count": len(g.unsupported),
        "id_like_columns_dropped_count": len(g.ids_dropped), "high_cardinality_columns_dropped_count": len(g.high_cardinality_dropped),
        "total_features_before_encoding": len(g.numeric) + len(g.categorical) + len(g.datetime),
    }
    runs = [{"run_id": parent, "param": k, "value": str(v)} for k, v in common.items()]
    runs += [{"run_id": child[m], "parent_id": parent, "model": m, "param": k, "value": str(v)} for m in names for k, v in (prepared | {"model_name": m}).items()]
    metrics = [{"run_id": child[r["model"]], "key": r["metric"], "value": r["value"]} for r in rows]
    metrics.append({"run_id": parent, "key": "best_model_score", "value": best["score"]})
    log = small_table(spark, runs, {k: "string" for k in ("run_id", "parent_id", "model", "param", "value")})
    scores = small_table(spark, metrics, {"run_id": "string", "key": "string", "value": "double"})
    return {
        "runs": log.withColumns({"param": param_name(F.col("param")), "value": param_value(F.col("value"))}),
        "metrics": scores.withColumn("key", metric_name(F.col("key"))),
    }


def append_run(baseline, path: str, run_id: str | None = None, save_model: bool = True) -> str:
    """Write the run log under `path` and save the best model; returns the run id.

    The rows lie in a partition named after the run (`log_id`), which a rerun with the same id replaces as a whole, so logging twice
    leaves one set of rows; other runs stay as they are.
    """
    run_id = run_id or uuid.uuid4().hex
    for name, table in run_log(baseline, run_id).items():
        marked = table.withColumn("log_id", F.lit(run_id)).repartition(1)  # a few rows per model
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_id").parquet(f"{path}/{name}")
    if save_model:
        best: PipelineModel = baseline.models[baseline.best.first()["model"]]
        best.write().overwrite().save(f"{path}/models/{run_id}")
    return run_id


def read_runs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """`runs` and `metrics` of all logged runs under `path`."""
    return {
        "runs": spark.read.schema("run_id string, parent_id string, model string, param string, value string, log_id string").parquet(f"{path}/runs"),
        "metrics": spark.read.schema("run_id string, key string, value double, log_id string").parquet(f"{path}/metrics"),
    }
