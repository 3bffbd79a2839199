import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gaugewell.errors import TrainingError
from gaugewell.operators import evaluate, explain, models, prep, split


def test_split_sizes_and_determinism(spark):
    df = spark.range(103).select("id", (F.col("id") % 10 == 0).cast("int").alias("t"))
    a = split.train_test_split(df, "id", "t").select("id", "t", "is_test")
    counts = {(r["t"], r["is_test"]): r["count"] for r in a.groupBy("t", "is_test").count().collect()}
    assert counts[(0, True)] + counts[(1, True)] == math.ceil(103 * 0.2) and counts[(1, True)] == 2
    b = split.train_test_split(df.repartition(5), "id", "t").select("id", "t", "is_test")
    assert a.exceptAll(b).count() == 0
    other = split.train_test_split(df, "id", "t", seed=7).select("id", "t", "is_test")
    assert a.exceptAll(other).count() > 0


def test_tiny_class_is_not_stratified(spark):
    df = spark.createDataFrame([(i, 1 if i else 0) for i in range(5)], "id int, t int")
    assert not split.stratify_check(df, "t").first()["can_stratify"]
    assert split.train_test_split(df, "id", "t").where("is_test").count() == 1
    assert split.safe_folds(df, "t", 5) is None


def test_folds_and_sample(spark):
    df = spark.range(47).select("id", (F.col("id") % 2).alias("t"))
    sizes = {(r["t"], r["fold"]): r["count"] for r in split.assign_folds(df, "id", "t", 5).groupBy("t", "fold").count().collect()}
    assert len(sizes) == 10 and max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == 47
    assert split.sample_rows(df, 10, "id").count() == 10 and split.sample_rows(df, 100, "id").count() == 47


def test_calendar_and_groups(datetime_df, high_cardinality_df):
    r = prep.calendar_features(datetime_df, ["signup_date"]).orderBy("signup_date").first()
    assert (r["signup_date_year"], r["signup_date_dayofweek"], r["signup_date_is_month_start"]) == (2024.0, 0.0, 1.0)
    g = prep.feature_groups(datetime_df, "churned")
    assert g.datetime == ["signup_date"] and g.numeric == ["usage_minutes"] and g.categorical == ["plan"]
    assert prep.feature_groups(high_cardinality_df, "target").ids_dropped == ["customer_code"]


def test_fill_scale_and_unknown_labels(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (4.0, "b"), (9.0, None), (None, "a")], "x double, c string")
    learned = prep.learn_numeric(df, ["x"]).first()
    assert learned["fill"] == 3.0 and learned["mean"] == pytest.approx(3.8)
    assert prep.learn_numeric(df.select(F.lit(2.0).alias("k")), ["k"]).first()["scale"] == 1.0
    model = prep.FeatureEncoder(prep.FeatureGroups(numeric=["x"], categorical=["c"])).fit(df)
    new = spark.createDataFrame([(None, "zzz"), (1.0, None)], "x double, c string")
    rows = [list(r[0]) for r in model.transform(new).select(vector_to_array("features")).collect()]
    assert rows[0][1:] == [0.0, 0.0] and rows[1][1:] == [1.0, 0.0]
    assert prep.feature_names(model.transform(new)) == ["numeric__x", "categorical__c_a", "categorical__c_b"]


def test_long_labels_and_category_limit(spark):
    long = "w" * 90
    df = spark.createDataFrame([(long,), (long,), ("b",), ("c",), ("d",), ("d",), ("d",)], "c string")
    model = prep.FeatureEncoder(prep.FeatureGroups(categorical=["c"])).fit(df)
    rows = {r["c"]: list(r["v"]) for r in model.transform(df).select("c", vector_to_array("features").alias("v")).collect()}
    assert all(sum(v) == 1.0 for v in rows.values()) and rows[long] != rows["b"]
    few = prep.FeatureEncoder(prep.FeatureGroups(categorical=["c"]), max_categories=3).fit(df)
    rows = {r["c"]: list(r["v"]) for r in few.transform(df).select("c", vector_to_array("features").alias("v")).collect()}
    assert len(rows["d"]) == 3 and rows["b"] == rows["c"] != rows["d"]


def test_class_metrics_by_hand(spark):
    pairs = [("0", "0")] * 5 + [("0", "1")] * 1 + [("1", "1")] * 2 + [("1", "0")] * 2
    m = {r["metric"]: r["value"] for r in evaluate.classification_metrics(spark.createDataFrame(pairs, "label string, prediction string"), "binary_classification").collect()}
    assert m["accuracy"] == 0.7 and m["balanced_accuracy"] == round((5 / 6 + 0.5) / 2, 4)
    assert m["precision_binary"] == round(2 / 3, 4) and m["recall_binary"] == 0.5


def test_auc_ties_and_buckets(spark, monkeypatch):
    rows = [(float(i % 40), (i * 7) % 11 < 5) for i in range(400)]
    df = spark.createDataFrame(rows, "score double, positive boolean").withColumn("group", F.lit("g"))
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluate.roc_auc(df).first()["auc"] == pytest.approx(want)
    monkeypatch.setattr(evaluate, "SCORES_PER_BUCKET", 5)
    assert evaluate.roc_auc(df).first()["auc"] == pytest.approx(want)


def test_regression_metrics_skip_zero_targets(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 9.0), (20.0, 22.0)], "label double, prediction double")
    m = {r["metric"]: r["value"] for r in evaluate.regression_metrics(df).collect()}
    assert m["mape"] == 10.0 and m["mae"] == round(4 / 3, 4) and m["mse"] == 2.0


def test_best_model_prefers_first_on_ties(spark):
    rows = [(0, "a", "f1_score", 0.5), (1, "b", "f1_score", 0.5), (0, "a", "rmse", 2.0), (1, "b", "rmse", 1.0)]
    df = spark.createDataFrame(rows, "position long, model string, metric string, value double")
    assert evaluate.best_model(df, "binary_classification").first()["model"] == "a"
    assert evaluate.best_model(df, "regression").first()["model"] == "b"


def test_regression_target_must_be_numeric(spark, multiclass_df):
    with pytest.raises(TrainingError):
        models.train_baselines(multiclass_df, "risk_band", "regression")


def test_baselines_and_additive_explanations(spark, datetime_df):
    df = datetime_df.withColumn("key", F.monotonically_increasing_id())
    b = models.train_baselines(df, "churned", "binary", "key", models.Settings(trees=3, depth=3, folds=2, max_iter=10, cross_validate=False))
    assert b.failures.count() == 0 and set(b.models) == {"Logistic Regression", "Random Forest Classifier"}
    assert b.details.first()["test_rows"] == 8 and b.classes == ["0", "1"]
    sample = b.encoder.transform(b.test).withColumn("row_id", F.col("key").cast("long"))
    names = prep.feature_names(sample)
    forest: PipelineModel = b.models["Random Forest Classifier"]
    phi, base = explain.tree_shap(forest.stages[-1], sample, names)
    chance = forest.stages[-1].transform(sample).select("row_id", F.posexplode(vector_to_array("probability")).alias("class_index", "p"))
    total = phi.groupBy("row_id", "class_index").agg(F.sum("phi").alias("s")).join(chance, ["row_id", "class_index"]).collect()
    assert total and all(abs(r["s"] + base[r["class_index"]] - r["p"]) < 1e-9 for r in total)
    assert explain.global_summary(explain.reduce_classes(phi, 2)).first()["direction"] == "positive"


def test_agnostic_values_add_up(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i % 5)) for i in range(12)], "row_id long, a double, b double")
    phi = explain.agnostic_shap(lambda d: d.withColumn("prediction", 3 * F.col("a") - F.col("b")), df, ["a", "b"], permutations=3, background=12)
    rows = {(r["row_id"], r["feature"]): r["phi"] for r in phi.collect()}
    shift = 3 * 11.0 - rows[(11, "a")]  # mean of the background values used
    assert all(rows[(i, "a")] == pytest.approx(3.0 * i - shift) for i in range(12))


def test_linear_folds_match_refitting(spark):
    import numpy as np

    from gaugewell.operators import folds

    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 3)) * [1, 50, 1e-3] + [1e6, 0, 5]
    y = 3e3 + x @ [0.5, -2.0, 900.0] + rng.normal(size=240)
    rows = [(float(a) if i % 5 else None, float(b) if i % 7 else float("inf"), float(c), 2.0, float(t) if i % 31 else float("nan"), i % 4) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, same double, y double, fold int")
    got = folds.linear_fold_scores(df, ["a", "b", "c", "same"], "y", 4)
    kept = [r for r in rows if r[4] == r[4]]
    want = []
    for k in range(4):
        fill = [np.median([r[j] for r in kept if r[5] != k and r[j] is not None and np.isfinite(r[j])]) for j in range(4)]
        z = np.array([[r[j] if r[j] is not None and np.isfinite(r[j]) else fill[j] for j in range(4)] for r in kept])
        t, inner = np.array([r[4] for r in kept]), np.array([r[5] != k for r in kept])
        mean = z[inner].mean(0)
        beta, *_ = np.linalg.lstsq(np.c_[np.ones(inner.sum()), z[inner] - mean], t[inner], rcond=None)
        want.append(np.sqrt(np.mean((t[~inner] - np.c_[np.ones((~inner).sum()), z[~inner] - mean] @ beta) ** 2)))
    assert got == pytest.approx(want, rel=1e-7)
    assert folds.linear_fold_scores(df.limit(0), ["a"], "y", 4) == [] and folds.linear_fold_scores(df.where("fold = 1"), ["a"], "y", 4) == []


def test_linear_baseline_is_cross_validated_in_one_pass(spark):
    rows = [(i, float(i % 13), float(i * i % 7), 2.0 * (i % 13) - (i * i % 7) + (i % 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, a double, b double, y double")
    found = models.train_baselines(df, "y", "regression", "k", models.Settings(folds=3), ["Linear Regression"])
    scores = {r["metric"]: r["value"] for r in found.metrics.collect()}
    assert 0 < scores["cv_mean"] < 1.2 and scores["cv_std"] < 0.2


def test_sparse_cells_equal_the_vectors(spark):
    rows = [(i, float(i % 9) if i % 4 else None, 3.0, "abcd"[i % 4 if i % 8 else 0] if i % 7 else None, f"2024-0{1 + i % 6}-1{i % 9}", i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, x double, same double, c string, day string, flag boolean")
    groups = prep.FeatureGroups(numeric=["x", "same"], categorical=["c", "flag"], datetime=["day"])
    later = df.withColumn("c", F.when(F.col("k") % 10 == 0, "new").otherwise(F.col("c")))
    for most in (0, 3):
        model = prep.FeatureEncoder(groups, max_categories=most).fit(df)
        encoded = model.transform(later)
        names = prep.feature_names(encoded)
        want = {(r["k"], names[i]): v for r in encoded.select("k", vector_to_array("features").alias("v")).collect() for i, v in enumerate(r["v"]) if v}
        found = prep.sparse_cells(later, "k", prep.fit_sparse(df, groups, max_categories=most)).collect()
        assert {(r["row_id"], r["slot"]): pytest.approx(r["value"]) for r in found} == want
