import pytest
from pyspark.sql import functions as F

from gaugewell.operators import leakage, quality


def found(df, target, *checks):
    return {(r["category"], r["column"]): r for r in quality.findings(df, target, list(checks) or None).collect()}


def test_messy_table(messy_df):
    f = found(messy_df, "label")
    assert f[("duplicate_rows", None)]["severity"] == "high"
    assert ("constant_column", "feature_b") in f and ("near_constant_column", "feature_b") in f
    assert f[("possible_id_column", "record_id")]["severity"] == "medium"
    assert not any(k[1] == "feature_a" and "missing" in k[0] for k in f)  # 18.18 % is below the limit


def test_missing_target_and_infinite(missing_target_df, infinite_df):
    assert found(missing_target_df, "target", "missing")[("target_missing_values", "target")]["severity"] == "high"
    assert {k[1] for k in found(infinite_df, "target", "infinite")} == {"feature_a", "feature_b"}
    assert not found(infinite_df, "target", "outliers")


def test_outliers_and_near_constant(spark):
    df = spark.createDataFrame([(float(v), 1) for v in [*range(10, 30), 1000, 1001]], "x double, t int")
    r = found(df, "t", "outliers")[("outliers", "x")]
    assert r["evidence"]["n_outliers"] == "2" and r["evidence"]["outlier_percent"] == "9.09" and r["severity"] == "medium"
    assert (r["evidence"]["lower"], r["evidence"]["upper"]) == ("-0.5", "41.5")
    df = spark.createDataFrame([("yes" if i < 96 else "no", i) for i in range(100)], "mostly string, t int")
    assert found(df, "t", "near_constant")[("near_constant_column", "mostly")]["evidence"]["dominant_percent"] == "96.0"


def test_ids_and_cardinality(high_cardinality_df, spark):
    f = found(high_cardinality_df, "target", "cardinality", "ids")
    assert f[("high_cardinality_column", "customer_code")]["severity"] == "high"
    assert f[("possible_id_column", "customer_code")]["severity"] == "high"
    plain = spark.range(100).select((F.col("id") * 1.5).alias("income"), (F.col("id") % 2).alias("t"))
    assert not found(plain, "t", "ids")


def test_duplicate_columns_need_equal_cells(spark):
    rows = [(i, i, 5 - i, None if i == 3 else i) for i in range(6)]
    df = spark.createDataFrame(rows, "a int, copy int, shuffled int, gap int").withColumn("t", F.col("a") % 2)
    assert {k[1] for k in found(df, "t", "duplicate_columns")} == {"copy"}


def test_mixed_types(spark):
    df = spark.createDataFrame([("1", "a", 0), ("x", "b", 1), ("2.5", "c", 0)], "m string, p string, t int")
    assert {k[1] for k in found(df, "t", "mixed")} == {"m"}


def test_score_caps_and_summary(spark):
    rows = [{"severity": "low", "category": "outliers", "column": f"c{i}", "message": "m", "evidence": {}, "recommendation": "r"} for i in range(10)]
    rows.append({"severity": "critical", "category": "invalid_target", "column": "t", "message": "m", "evidence": {}, "recommendation": "q"})
    f = quality._ranked(quality.small_table(spark, rows, quality.FINDING_SCHEMA))
    r = quality.quality_score(f).first()
    assert r["score"] == 100 - 12 - 35 and r["health_label"] == "poor"
    assert sum(x["penalty"] for x in quality.penalties(f).collect()) == 47
    assert [x["action"] for x in quality.recommended_actions(f).orderBy("position").collect()] == ["q", "r"]
    empty = f.limit(0)
    assert quality.quality_score(empty).first()["score"] == 100.0
    assert quality.recommended_actions(empty).collect()[0]["action"] == "No action needed."
    assert {x["name"]: x["findings"] for x in quality.finding_summary(empty).where("kind = 'severity'").collect()} == {s: 0 for s in quality.SEVERITIES}


def test_leaky_table(leaky_df):
    risks = {(r["column"], r["risk_type"]): r for r in leakage.risks(leaky_df, "result").collect()}
    assert risks[("target_copy", "duplicate_target_risk")]["risk_level"] == "critical"
    assert risks[("target_copy", "duplicate_target_risk")]["evidence"]["same_values_ratio"] == "1.0"
    assert risks[("target_copy", "name_based_risk")]["risk_level"] == "medium"
    assert ("total", "name_based_risk") in risks and ("student_id", "high_cardinality_identifier_risk") in risks
    assert not any(r["is_confirmed_leakage"] for r in risks.values())
    out = leakage.leakage_check(leaky_df, "Result")
    assert out["overall"].first()["overall_severity"] == "critical"
    top = out["review_columns"].where("column = 'target_copy'").first()
    assert top["highest_risk_level"] == "critical" and top["risk_count"] >= 2
    assert min(r["position"] for r in out["actions"].collect()) == 0


def test_formula_target(spark):
    df = spark.range(30).select((F.col("id") * 1.0).alias("target"), (F.col("id") * 2.0).alias("target_formula"), (F.col("id") % 3).alias("other"))
    r = leakage.correlation_risks(df, "target").collect()
    assert [(x["column"], x["risk_level"], x["evidence"]["correlation_with_target"]) for x in r] == [("target_formula", "high", "1.0")]


def test_separation(spark):
    rows = [("no", 1.0 if i % 2 else 2.0) for i in range(10)] + [("yes", 94.0 if i % 2 else 95.0) for i in range(10)]
    r = leakage.separation_risks(spark.createDataFrame(rows, "t string, proxy double"), "t").first()
    assert r["evidence"]["separation_ratio"] == "0.9841" and '"no":1.5' in r["evidence"]["class_means"]


def test_names_match_tokens_only(spark):
    df = spark.createDataFrame([(1, 1, 1, 0)], "classic_car int, outcomes int, passenger int, churn int")
    assert leakage.name_risks(df, "churn").count() == 0


def test_nulls_are_no_match_and_numbers_align(spark):
    rows = [(None, None, 1)] * 5 + [(float(i), i, i) for i in range(12)]
    df = spark.createDataFrame(rows, "f double, g int, t int").withColumn("t", F.when(F.col("g").isNotNull(), F.col("t")))
    s = {r["column"]: r for r in leakage.duplicate_target_stats(df, "t").collect()}
    assert (s["f"]["compared_rows"], s["f"]["equal_rows"]) == (12, 12)


def test_mutual_information_bounds(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("string").alias("t"), ((F.col("id") % 2) * 10 + (F.col("id") % 3)).alias("x"), F.lit(1).alias("k"))
    r = {x["column"]: x["mutual_information"] for x in leakage.mutual_information(df, "t").collect()}
    assert set(r) == {"x"} and r["x"] == pytest.approx(0.6931 - 5 / 800, abs=2e-3)  # six bins, two classes


@pytest.mark.parametrize("rows_per_cell", [1, None])
def test_neighbour_information_against_every_pair(spark, rows_per_cell):
    import math
    import random

    from gaugewell.operators.neighbours import digamma, neighbour_information

    rng, rows = random.Random(6), []
    for i in range(260):
        y = "abc"[i % 3] if i % 40 else ("rare" if i else "alone")
        x = rng.gauss(i % 3, 0.7)
        rows.append((y if i % 50 != 7 else None, None if i % 17 == 3 else x, float(rng.randrange(6)), float("inf") if i == 9 else round(x, 1), 5.0, "ab".index(y) if y in "ab" else 2))
    df = spark.createDataFrame(rows, "y string, x double, ties double, `near ties` double, same double, code int")
    found = {r["column"]: r for r in neighbour_information(df, "y", 3, rows_per_cell).collect()}
    assert set(found) == {"x", "ties", "near ties", "code"}
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    got = spark.range(1, 40).select("id", digamma(F.col("id")).alias("d")).collect()
    assert all(abs(r["d"] - psi(r["id"])) < 1e-9 for r in got)
    labelled = [r for r in rows if r[0] is not None]
    sizes = {y: sum(r[0] == y for r in labelled) for y in {r[0] for r in labelled}}
    for i, name in enumerate(df.columns[1:], 1):
        if name == "same":
            continue
        own = sorted(r[i] for r in labelled if r[i] is not None and math.isfinite(r[i]))
        middle = (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2
        points = [(r[0], r[i] if r[i] is not None and math.isfinite(r[i]) else middle) for r in labelled if sizes[r[0]] > 1]
        total = 0.0
        for a, (y, v) in enumerate(points):
            r = sorted(abs(v - u) for b, (z, u) in enumerate(points) if z == y and b != a)[:3][-1]
            inside = [z for z, u in points if (v - r < u < v + r if r else u == v)]
            total += psi(inside.count(y)) - psi(sizes[y]) - psi(len(inside))
        assert found[name]["rows_used"] == len(points)
        assert found[name]["mutual_information"] == pytest.approx(max(0.0, psi(len(points)) + total / len(points)), abs=1e-7)
    assert neighbour_information(df.limit(0), "y").count() == 0
