import math

import pytest
from pyspark.sql import functions as F

from gaugewell.errors import AuditError, TargetError
from gaugewell.operators import profile, schema, stats
from gaugewell.operators.facts import gather
from gaugewell.operators.schema import columns_of


def by(df, key="column"):
    return {r[key]: r for r in df.collect()}


def test_numeric_summary_with_nan_and_infinity(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,), (3.5,), (float("nan"),), (float("inf"),), (None,)], "x double")
    r = by(profile.numeric_summary(df))["x"]
    assert (r["count"], r["missing_count"], r["infinite_count"]) == (5, 3, 1)
    assert r["q25"] == 2.0 and r["median"] == 3.5 and r["q75"] == 4.0
    assert r["mean"] == 3.9 and r["min"] == 1.0 and r["max"] == 9.0
    values = [1, 2, 4, 9, 3.5]
    mean, n = 3.9, 5
    m2 = sum((v - mean) ** 2 for v in values) / n
    g1 = sum((v - mean) ** 3 for v in values) / n / m2**1.5
    assert r["skewness"] == pytest.approx(math.sqrt(n * (n - 1)) / (n - 2) * g1, abs=1e-4)


def test_numeric_summary_edge_counts(spark):
    df = spark.createDataFrame([(1.0, None, 5), (2.0, None, 5)], "a double, b double, c int")
    rows = by(profile.numeric_summary(df))
    assert rows["a"]["skewness"] == 0.0 and rows["a"]["kurtosis"] == 0.0
    assert rows["b"]["count"] == 0 and rows["b"]["mean"] is None and rows["b"]["skewness"] is None
    assert rows["c"]["std"] == 0.0


def test_quantiles_survive_narrow_and_missed_brackets(spark):
    df = spark.range(3000).select(((F.col("id") * 7919) % 3001).cast("double").alias("x"), F.lit(4.0).alias("hot"))
    _, found = stats.scan(df, {"quantiles"})
    plain = stats.exact_quantiles(df, [0.25, 0.5, 0.75], found)
    assert stats.exact_quantiles(df, [0.25, 0.5, 0.75], found, limit=5) == plain
    missed = {k: dict(v, brackets=[v["max"]] * 6) for k, v in found.items()}
    assert stats.exact_quantiles(df, [0.25, 0.5, 0.75], missed, limit=50) == plain
    values = sorted((i * 7919) % 3001 for i in range(3000))
    at = 2999 * 0.25
    low = int(at)
    assert plain["x"][0] == pytest.approx(values[low] + (values[low + 1] - values[low]) * (at - low))
    assert plain["hot"] == [4.0, 4.0, 4.0]


def test_quantiles_of_extreme_values(spark):
    df = spark.createDataFrame([(-1.7e308,), (-1.0,), (5e-324,), (1.6e308,), (1.7e308,)], "x double")
    assert stats.quantiles_of(df, ["x"], [0.25, 0.5, 0.75])["x"] == [-1.0, 5e-324, 1.6e308]


def test_type_groups_and_dates(spark):
    df = spark.createDataFrame(
        [("2024-01-05", "red", True, 1, [1]), ("2024-02-06", "blue", False, 2, [2]), ("bad", "red", None, 3, [3]),
         ("2024-03-01 10:00:00", "x", True, 4, [4]), ("01/31/2024", "y", True, 5, [5])],
        "day string, colour string, flag boolean, n int, tags array<int>")
    groups = {r["column"]: r["type_group"] for r in profile.column_types(df).collect()}
    assert groups == {"day": "datetime", "colour": "categorical", "flag": "boolean", "n": "numeric", "tags": "unsupported"}
    assert by(profile.boolean_summary(df))["flag"]["true_count"] == 3
    assert by(profile.datetime_summary(df))["day"]["parse_success_count"] == 4


def test_top_values_count_nulls_and_break_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",), ("b",), ("c",)], "v string")
    rows = [(r["value"], r["count"]) for r in profile.top_values(df, ["v"], 3).orderBy("position").collect()]
    assert rows == [("a", 2), ("b", 2), ("c", 1)]


def test_duplicates_treat_null_and_nan_as_equal(spark):
    nan = float("nan")  # NaN is a missing cell, so the three (missing, x) rows are copies of one another
    df = spark.createDataFrame([(1.0, None), (1.0, None), (nan, "x"), (nan, "x"), (None, "x"), (0.0, "z"), (-0.0, "z")], "a double, b string")
    assert profile.duplicate_rows(df).first()["duplicate_rows"] == 4


def test_profile_tables_and_warnings(messy_df):
    tables = profile.profile(messy_df, "label")
    shape = tables["shape"].first()
    assert (shape["row_count"], shape["column_count"], shape["duplicate_rows"], shape["missing_cells"]) == (11, 5, 1, 2)
    assert shape["duplicate_row_percent"] == 9.09
    assert {r["warning"] for r in tables["warnings"].collect()} == {"few_rows", "duplicate_rows"}
    assert tables["target"].first()["unique_count"] == 2
    assert not profile.target_summary(messy_df, "nope").first()["target_exists"]


def test_resolver_and_structure(spark, classification_df):
    assert schema.resolve_target(classification_df, " Approved ") == "approved"
    with pytest.raises(TargetError, match="approved"):
        schema.resolve_target(classification_df, "aproved")
    with pytest.raises(AuditError):
        schema.check_structure(classification_df.limit(0))
    with pytest.raises(AuditError):
        schema.check_structure(classification_df.select("age", "age"))
    with pytest.raises(TargetError):
        schema.validate_target(spark.createDataFrame([(1, 1), (2, 1)], "a int, t int"), "t")


def test_column_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y")], "`a.b` double, `c d` string")
    facts = gather(df, "c d", {"numeric", "quantiles", "frequency"})
    assert facts["a.b"]["median"] == 1.5 and facts["c d"]["n_distinct"] == 2


def test_long_texts_count_whole_cells(spark):
    base = "x" * 500
    df = spark.createDataFrame([(base + "1",), (base + "2",), (base + "1",)], "t string")
    facts = gather(df, None, {"frequency"})
    assert facts["t"]["n_distinct"] == 2 and facts["t"]["dominant_count"] == 2 and facts["t"]["dominant_value"] == base + "1"
    assert profile.top_values(df, ["t"]).orderBy("position").first()["value"] == base + "1"


def test_sketched_distinct_counts_keep_the_dominant_value(spark):
    df = spark.range(200).select(
        F.when(F.col("id") < 195, 7.0).otherwise(F.col("id")).alias("mostly"), (F.col("id") % 40).alias("spread"),
        F.when(F.col("id") < 3, 1).alias("gaps"), (F.col("id") % 2).alias("t"))
    exact, quick = gather(df, "t", {"frequency"}), gather(df, "t", {"frequency"}, exact_distinct=False)
    for name in ("mostly", "gaps"):
        assert quick[name]["dominant_count"] == exact[name]["dominant_count"]
    assert quick["mostly"]["dominant_value"] == "7.0" and quick["gaps"]["dominant_value"] is None
    assert abs(quick["spread"]["n_distinct"] - 40) <= 4


def _texts(spark):
    """Long texts that share heads, repeat, tie in count and differ late; short ones; gaps."""
    long = [f"{'https://example.org/a/common/path/'}{i:04d}" for i in range(300)]
    rows = long + ["x" * 40 + "b"] * 3 + ["x" * 40 + "a"] * 3 + ["x" * 40 + "c"] * 4 + ["x" * 32] * 3 + ["short"] * 3 + [None] * 2 + [""] + long[250:252]
    return spark.createDataFrame([(r, i % 7) for i, r in enumerate(rows)], "t string, n int"), rows


def test_top_cells_read_ties_whole(spark):
    df, rows = _texts(spark)
    from collections import Counter

    want = sorted(Counter(rows).items(), key=lambda v: (-v[1], v[0] is None, v[0] or ""))
    for k in (2, 6, 12, 400):
        for most in (10_000, 3)[k == 400:]:
            got = stats.top_cells(df, {"t": F.col("t"), "n": F.col("n").cast("string")}, k, most)
            assert got["t"] == want[:k]
            assert got["n"][0][1] == max(Counter(i % 7 for i in range(len(rows))).values())
    plain = sorted({r for r in rows if r is not None})
    for k in (3, 400):
        assert stats.smallest_texts(df, F.col("t"), k, 3) == plain[:k] == stats.smallest_texts(df, F.col("t"), k)


def test_dominant_long_text_and_its_sketch(spark):
    df, rows = _texts(spark)
    found = stats.frequency_summary(df, [c for c in columns_of(df) if c.name == "t"], len(rows))["t"]
    assert (found["n_distinct"], found["dominant_count"], found["dominant_value"]) == (306, 4, "x" * 40 + "c")
    many = df.crossJoin(spark.range(3)).select("t").unionByName(spark.createDataFrame([("y" * 500,)] * 4000 + [("z" * 99,)] * 1500, "t string"))
    info, n = columns_of(many), many.count()
    exact, sketch = stats.frequency_summary(many, info, n)["t"], stats.heavy_hitters(many, info, n)["t"]
    assert sketch["dominant_value"] == exact["dominant_value"] == "y" * 500 and sketch["dominant_count"] == exact["dominant_count"] == 4000
    assert abs(sketch["n_distinct"] - exact["n_distinct"]) <= 0.04 * exact["n_distinct"]
    assert sketch["n_distinct"] - sketch["n_rare"] == exact["n_distinct"] - exact["n_rare"] == 2
    empty = stats.heavy_hitters(many.limit(0), info, 0)["t"]
    assert (empty["n_distinct"], empty["dominant_count"], empty["dominant_value"], empty["n_rare"]) == (0, 0, None, 0)


def test_quantiles_after_filling_without_filling(spark):
    rows = [(float(i % 17) if i % 3 else None, float(i) if i % 5 else float("nan"), 2.0, None if i % 2 else float(i % 4), i) for i in range(61)]
    df = spark.createDataFrame(rows, "a double, b double, same double, c double, full int")
    probs = [i / 10 for i in range(1, 10)]
    medians, cuts, _ = stats.filled_quantiles(df, df.columns, probs, unfilled=["b"])
    assert set(medians) == {"a", "b", "c", "full"}
    for i, name in enumerate(df.columns):
        if name == "same":
            continue
        own = sorted(r[i] for r in rows if r[i] is not None and r[i] == r[i])
        at = lambda v, p: v[int((len(v) - 1) * p)] + (v[min(int((len(v) - 1) * p) + 1, len(v) - 1)] - v[int((len(v) - 1) * p)]) * ((len(v) - 1) * p % 1)
        assert medians[name] == pytest.approx(at(own, 0.5))
        whole = sorted(own + ([] if name == "b" else [medians[name]] * (len(rows) - len(own))))
        assert cuts[name] == pytest.approx([at(whole, p) for p in probs])


def test_outliers_in_the_pass_of_the_quartiles(spark):
    df = spark.range(5000).select((F.sin("id") * F.col("id") + F.when(F.col("id") % 400 == 0, 9e4).otherwise(0)).alias("x"), F.when(F.col("id") % 50 == 0, 1e6).otherwise(F.col("id") % 7).alias("y"), F.lit(1.0).alias("same"))
    _, found = stats.scan(df, {"quantiles"})
    apart = {k: dict(v) for k, v in found.items()}
    q = stats.exact_quantiles(df, [0.25, 0.5, 0.75], found, fence=1.5)
    assert stats.exact_quantiles(df, [0.25, 0.5, 0.75], apart, limit=5, fence=1.5) == q and "n_outside" not in apart["x"]
    for name in ("x", "y"):
        low, high = q[name][0] - 1.5 * (q[name][2] - q[name][0]), q[name][2] + 1.5 * (q[name][2] - q[name][0])
        assert found[name]["n_outside"] == df.where((F.col(name) < low) | (F.col(name) > high)).count() > 0
    assert "n_outside" not in found["same"]
