"""Steps that took too long on large tables: what they read, and that their results stay the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewell.operators import explain, facts, leakage, models, prep, split, stats


def test_identifiers_count_only_columns_that_can_be_flagged(spark, monkeypatch):
    df = spark.range(60).select("id", F.col("id").alias("amount"), F.concat(F.lit("r"), "id").alias("ref"), (F.col("id") % 2).alias("y"))
    seen = []
    gather = facts.gather
    monkeypatch.setattr(leakage.facts_mod, "gather", lambda *a, **k: seen.append(gather(*a, **k)) or seen[-1])
    found = {r["column"]: r["evidence"]["n_distinct"] for r in leakage.identifier_risks(df, "y").collect()}
    assert found == {"id": "60", "ref": "60"}
    assert "amount" not in seen[0].by_column


def test_numbers_equal_a_text_target_only_as_written(spark):
    rows = [(7, 7.0, "7"), (7, 7.0, "7.0"), (7, 7.0, "07"), (0, -0.0, "0.0"), (0, -0.0, "-0.0"), (1, float("inf"), "Infinity"), (1, float("nan"), "NaN"), (1, 1e7, "1.0E7"), (1, 2.0, "x"),
            (1, 2.0, None), (None, None, "1")]
    df = spark.createDataFrame(rows, "a int, b double, y string")
    plans = []
    reduce_cells = stats.reduce_cells
    stats.reduce_cells = lambda d, *a, **k: plans.append(d.columns) or reduce_cells(d, *a, **k)
    try:
        got = {r["column"]: (r["compared_rows"], r["equal_rows"], r["rows"]) for r in leakage.duplicate_target_stats(df, "y").collect()}
    finally:
        stats.reduce_cells = reduce_cells
    assert got == {"a": (9, 1, 11), "b": (8, 4, 11)}
    assert len(plans[0]) == 5  # the target is read as an int and as a double once a row


def test_many_brackets_are_counted_in_short_projections(spark):
    assert stats._batches([19] * 10, stats.PICKED) == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9]]
    assert stats._batches([90, 5, 5], stats.PICKED) == [[0], [1, 2]]
    df = spark.range(3000).select(*[(F.col("id") * (i + 7) % 2999).cast("double").alias(f"c{i}") for i in range(8)])
    found = stats.quantiles_of(df, df.columns, [i / 20 for i in range(1, 20)])
    table = df.toPandas()
    for name, values in found.items():
        assert all(abs(v - table[name].quantile(i / 20)) < 1e-9 for i, v in enumerate(values, 1))


def test_walks_of_a_row_stay_in_one_task(spark):
    df = spark.range(80).select(F.col("id").alias("row_id"), (F.col("id") * 0.5).alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    out = explain.agnostic_shap(lambda d: d.withColumn("prediction", F.expr("2D * a - 3D * b + 1")), df, ["a", "b"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "walk" in line]
    table = df.toPandas()
    first = table.nsmallest(explain.BACKGROUND_ROWS, "row_id")
    want = {(int(r.row_id), c): w * (getattr(r, c) - first[c].mean()) for r in table.itertuples() for c, w in (("a", 2), ("b", -3))}
    got = {(r["row_id"], r["feature"]): r["phi"] for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_split_finds_its_thresholds_once(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).cast("string").alias("c"))
    for labelled in (split.train_test_split(df, "id", "c"), split.assign_folds(df, "id", "c", 4)):
        plan = labelled._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Window" not in plan


def test_baselines_share_the_encoders_of_the_folds(spark, monkeypatch):
    df = spark.range(120).select("id", (F.col("id") % 11).cast("double").alias("x"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("t"),
                                 (F.col("id") % 11 * 2 + F.col("id") % 3).cast("double").alias("y"))
    fitted, fit = [], prep.FeatureEncoder._fit
    monkeypatch.setattr(prep.FeatureEncoder, "_fit", lambda self, d: fitted.append(1) or fit(self, d))
    found = models.train_baselines(df, "y", "regression", "id", models.Settings(folds=3, trees=2, depth=2))
    assert {r["model"] for r in found.metrics.where("metric = 'cv_mean'").collect()} == {"Linear Regression", "Random Forest Regressor"}
    assert len(fitted) == 4  # the training rows and three folds, once for both models


def test_copies_of_one_key_are_not_sorted_in_one_task(spark, monkeypatch):
    df = spark.range(6000).select((F.col("id") % 2).alias("k"), (F.col("id") % 1500).alias("v"))
    monkeypatch.setattr(split, "SORTED_ROWS", 10 ** 9)
    want = split.train_test_split(df, "k", seed=3).where("is_test").groupBy("k", "v").count().collect()
    keys = split._keyed(df, "k", 3, None).select("__h").toPandas()["__h"].sort_values()
    monkeypatch.setattr(split, "SORTED_ROWS", 50)
    sizes, edges = [], split._edges
    monkeypatch.setattr(split, "_edges", lambda *a: sizes.append(edges(*a)) or sizes[-1])
    got = split.train_test_split(df, "k", seed=3).where("is_test").groupBy("k", "v").count().collect()
    assert sorted(got) == sorted(want) and sum(r["count"] for r in got) == 1200
    assert sizes[0].first()["cnt"] == 3000 and sizes[-1].first()["cnt"] <= 50
    ranks = spark.createDataFrame([("all", p, r) for p, r in enumerate((1, 2999, 3000, 3001, 6000), 1)], "__s string, part int, rank long")
    cuts = split._thresholds(split._keyed(df, "k", 3, None), ranks, 6000, 5).first()["cuts"]
    assert cuts == [keys.iloc[r - 1] for r in (1, 2999, 3000, 3001, 6000)]


def test_facts_of_texts_are_read_off_distinct_texts(spark, monkeypatch):
    long_day, long_true = " " * 20 + "2024-03-01" + " " * 20, " " * 30 + "yes" + " " * 30
    rows = [("true", "1", long_day, None, long_true), ("true", "x", "2023-01-05", None, "no"), ("false", "2.5", " ", None, "y" * 40), (None, "2024-01-01", long_day, None, "y" * 40)] * 3
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string").withColumn("f", F.col("a") == "true")
    infos, want = facts.columns_of(df), {"numeric", "labels", "dates", "classes"}
    n_rows, scanned = stats.scan(df, want, infos)
    monkeypatch.setattr(stats, "reduce_cells", lambda *a, **k: 1 / 0)
    found = facts.gather(df, None, want | {"frequency"})
    assert found.n_rows == n_rows == 12
    for name, entry in scanned.items():
        assert {k: found[name].get(k) for k in entry} == entry
    assert [found[c]["n_distinct"] for c in "abcdef"] == [2, 4, 3, 0, 3, 2] and found["c"]["dominant_value"] == long_day
