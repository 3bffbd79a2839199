"""Dataset profile: per-type column summaries, target summary, shape and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gaugewell.functions import cells
from gaugewell.functions.small import small_table
from gaugewell.operators import facts as facts_mod, stats
from gaugewell.operators.facts import Facts
from gaugewell.operators.schema import columns_of, type_groups

TOP_CATEGORIES = 10
TOP_TARGET_VALUES = 20
MISSING_LABEL = "NaN"


def infer_dates(df: DataFrame, threshold: float = 0.8, facts: Facts | None = None) -> DataFrame:
    """String columns whose non-blank cells parse as dates at the threshold rate, over all rows."""
    found = facts or facts_mod.gather(df, None, {"dates"}, [c.name for c in columns_of(df) if c.group == "categorical"])
    rate = F.round(F.col("n_parsed") / F.col("n_nonblank"), 4)
    return (
        found.table.where("type_group = 'categorical' AND n_nonblank > 0")
        .select("column", "n_nonblank", "n_parsed", rate.alias("parse_rate"))
        .withColumn("is_datetime", F.col("n_parsed") / F.col("n_nonblank") >= threshold)
    )


def date_columns(df: DataFrame, threshold: float = 0.8, facts: Facts | None = None) -> list[str]:
    rows = infer_dates(df, threshold, facts).where("is_datetime").select("column").collect()
    return [r["column"] for r in rows]


def column_types(df: DataFrame, threshold: float = 0.8, facts: Facts | None = None) -> DataFrame:
    """Type group of each column, string columns that hold dates counted as datetime."""
    return type_groups(df, date_columns(df, threshold, facts))


_COUNTS = ["column", "count", "missing_count", "missing_percent"]


def _counted(table: DataFrame) -> DataFrame:
    return table.withColumns({"count": F.col("n_present"), "missing_count": F.col("n_missing")})


def numeric_summary(df: DataFrame, columns: list[str] | None = None, facts: Facts | None = None) -> DataFrame:
    """Count, missing, moments, quartiles and infinities; infinities count as missing."""
    if facts is None:
        names = [c.name for c in columns_of(df, columns) if c.group == "numeric"]
        facts = facts_mod.gather(df, None, {"numeric", "quantiles"}, names)
    n = F.col("n_valid").cast("double")
    skew = F.when(F.col("n_valid") > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1")).otherwise(0.0)
    tails = F.when(
        F.col("n_valid") > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    ).otherwise(0.0)
    some = F.col("n_valid") > 0
    gone = F.col("n_rows") - F.col("n_valid")
    rounded = {k: F.round(v, 4) for k, v in {
        "mean": F.col("mean"), "std": F.col("std"), "min": F.col("min"), "q25": F.col("q25"),
        "median": F.col("median"), "q75": F.col("q75"), "max": F.col("max"),
        # A constant column has no shape: 0/0 is reported as 0.
        "skewness": F.when(some, F.coalesce(F.when(~F.isnan(skew), skew), F.lit(0.0))),
        "kurtosis": F.when(some, F.coalesce(F.when(~F.isnan(tails), tails), F.lit(0.0))),
    }.items()}
    return facts.table.where("type_group = 'numeric'").select(
        "column", F.col("n_valid").alias("count"), gone.alias("missing_count"),
        cells.percent(gone, F.col("n_rows")).alias("missing_percent"),
        *[c.alias(k) for k, c in rounded.items()],
        (F.col("pos_inf") + F.col("neg_inf")).alias("infinite_count"),
    )


def infinite_counts(df: DataFrame) -> DataFrame:
    """(column, infinite_count) for numeric columns."""
    names = [c.name for c in columns_of(df) if c.group == "numeric"]
    found = facts_mod.gather(df, None, {"infinite"}, names)
    return found.table.select("column", (F.col("pos_inf") + F.col("neg_inf")).alias("infinite_count"))


def top_values(df: DataFrame, columns: list[str], k: int = TOP_CATEGORIES) -> DataFrame:
    """The k most frequent cells per column (null is a cell), ties by smallest value."""
    exprs = {c.name: cells.text_key(c.name, c.dtype) for c in columns_of(df, columns)}
    total = df.count()
    rows = [
        {"column": name, "position": i + 1, "value": MISSING_LABEL if value is None else value, "count": cnt, "n": total}
        for name, found in stats.top_cells(df, exprs, k).items() for i, (value, cnt) in enumerate(found)
    ]
    shown = small_table(df.sparkSession, rows, {"column": "string", "position": "long", "value": "string", "count": "long", "n": "long"})
    return shown.select("column", "position", "value", "count", cells.percent(F.col("count"), F.col("n")).alias("percent"))


def categorical_summary(df: DataFrame, facts: Facts | None = None, dates_found: list[str] | None = None) -> DataFrame:
    """Count, missing and distinct values of string columns that are not dates."""
    names = [c.name for c in columns_of(df) if c.group == "categorical"]
    facts = facts or facts_mod.gather(df, None, {"frequency", "dates"}, names)
    skip = date_columns(df, facts=facts) if dates_found is None else dates_found
    table = facts.table.where("type_group = 'categorical'").where(~F.col("column").isin(list(skip)))
    return _counted(table).select(*_COUNTS, F.col("n_distinct").alias("unique_count"), "unique_percent")


def boolean_summary(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    names = [c.name for c in columns_of(df) if c.group == "boolean"]
    facts = facts or facts_mod.gather(df, None, {"numeric"}, names)
    return _counted(facts.table.where("type_group = 'boolean'")).select(
        *_COUNTS, F.col("n_true").alias("true_count"), F.col("n_false").alias("false_count")
    )


def datetime_summary(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Parse rate and range of native and inferred datetime columns."""
    names = [c.name for c in columns_of(df) if c.group in ("categorical", "datetime")]
    facts = facts or facts_mod.gather(df, None, {"dates"}, names)
    inferred = date_columns(df, facts=facts)
    table = facts.table.where((F.col("type_group") == "datetime") | F.col("column").isin(inferred))
    return table.select(
        "column", F.col("n_parsed").alias("parse_success_count"),
        cells.percent(F.col("n_parsed"), F.col("n_rows")).alias("parse_success_percent"),
        (F.col("n_rows") - F.col("n_parsed")).alias("missing_or_invalid_count"),
        F.col("ts_min").alias("min"), F.col("ts_max").alias("max"),
    )


def target_summary(df: DataFrame, target: str, facts: Facts | None = None) -> DataFrame:
    """One row about the target; `target_exists` is false when the column is absent."""
    if target not in df.columns:
        return small_table(
            df.sparkSession, [{"target_column": target, "target_exists": False}],
            {"target_column": "string", "target_exists": "boolean"},
        )
    facts = facts or facts_mod.gather(df, target, {"frequency"}, [target])
    return facts.table.where(F.col("column") == target).select(
        F.col("column").alias("target_column"), F.lit(True).alias("target_exists"), "dtype",
        F.col("n_missing").alias("missing_count"), "missing_percent", F.col("n_distinct").alias("unique_count"),
        "unique_percent", F.col("type_group").isin("numeric", "boolean").alias("is_numeric"),
        (F.col("type_group") == "boolean").alias("is_boolean"),
    )


def sample_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k smallest distinct non-null values as text."""
    info = columns_of(df, [column])[0]
    if info.group == "categorical":
        rows = [{"column": column, "value": v} for v in stats.smallest_texts(df, cells.text_key(column, info.dtype), k)]
        return small_table(df.sparkSession, rows, {"column": "string", "value": "string"})
    value = cells.present(column, info.dtype).alias("v")
    return (
        df.select(value).where("v IS NOT NULL").groupBy("v").agg(F.lit(1).alias("one"))
        .orderBy("v").limit(k).select(F.lit(column).alias("column"), F.col("v").cast("string").alias("value"))
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(rows, duplicate_rows, duplicate_percent)."""
    counted = stats.duplicate_row_count(df)
    return counted.withColumn("duplicate_percent", cells.percent(F.col("duplicate_rows"), F.col("rows")))


def dataset_shape(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Rows, columns, duplicate rows and missing cells of the table."""
    facts = facts or facts_mod.gather(df)
    width = len(df.columns)
    missing = sum(f["n_missing"] for f in facts.by_column.values())
    unsupported = sum(c.group == "unsupported" for c in columns_of(df))
    return duplicate_rows(df).select(
        F.col("rows").alias("row_count"), F.lit(width).cast("long").alias("column_count"), "duplicate_rows",
        F.col("duplicate_percent").alias("duplicate_row_percent"), F.lit(missing).cast("long").alias("missing_cells"),
        cells.percent(F.lit(missing), F.col("rows") * width).alias("missing_cells_percent"),
        F.lit(unsupported).cast("long").alias("unsupported_columns"),
    )


def profile_warnings(shape: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """One row per warning that applies to the shape and the target summary."""
    row = target.first().asDict() if target is not None else {"target_exists": False}
    has, gaps = bool(row["target_exists"]), int(row.get("missing_count") or 0)
    rules = [
        ("row_count < 50", "'few_rows'", "'Fewer than 50 rows: model scores will be unstable.'"),
        ("column_count < 2", "'few_columns'", "'Fewer than 2 columns.'"),
        ("duplicate_rows > 0", "'duplicate_rows'", "concat(duplicate_rows, ' rows repeat another row.')"),
        ("unsupported_columns > 0", "'unsupported_columns'", "'Columns of unsupported types are left out of the features.'"),
        (str(not has).lower(), "'target_not_found'", "'The target column is not in the table.'"),
        (str(gaps > 0).lower(), "'target_missing_values'", "'The target column has missing values.'"),
    ]
    arms = [
        f"CASE WHEN {cond} THEN named_struct('position', {i}L, 'warning', {code}, 'message', {text}) END"
        for i, (cond, code, text) in enumerate(rules)
    ]
    return shape.select(F.inline(F.expr(f"array_compact(array({', '.join(arms)}))")))


def profile(df: DataFrame, target: str | None = None) -> dict[str, DataFrame]:
    """All profile tables. The shared facts are gathered once."""
    facts = facts_mod.gather(df, target, {"numeric", "quantiles", "dates", "frequency"})
    inferred = date_columns(df, facts=facts)
    shape = dataset_shape(df, facts)
    strings = [c.name for c in columns_of(df) if c.group == "categorical" and c.name not in inferred]
    about = target_summary(df, target, facts) if target is not None else None
    out = {
        "shape": shape,
        "column_types": type_groups(df, inferred),
        "numeric": numeric_summary(df, facts=facts),
        "categorical": categorical_summary(df, facts, inferred),
        "boolean": boolean_summary(df, facts),
        "datetime": datetime_summary(df, facts),
        "warnings": profile_warnings(shape, about),
    }
    if strings:
        out["top_values"] = top_values(df, strings)
    if about is not None:
        out["target"] = about
        if target in df.columns:
            out["target_values"] = top_values(df, [target], TOP_TARGET_VALUES)
            out["target_samples"] = sample_values(df, target)
    return out
