"""Cases that once gave wrong answers: long texts, repeated keys, copies, noise, wide tables, large integers, encodings, letters."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gaugewell.functions import names
from gaugewell.operators import imbalance, leakage, profile, split, stats
from gaugewell.operators.schema import columns_of
from gaugewell.sources.readers import read_csv


def test_long_texts_are_shown_whole(spark):
    a, b = "a" * 70, "b" * 90
    df = spark.createDataFrame([(a,), (a,), (b,), (b,), ("c",)], "label string")
    assert {r["class"] for r in imbalance.class_distribution(df, "label").select(F.col("class")).collect()} == {a, b, "c"}
    top = profile.top_values(df, ["label"]).orderBy("position").collect()
    assert [r["value"] for r in top] == [a, b, "c"]


def test_samples_and_splits_are_exact_without_a_unique_key(spark):
    df = spark.range(2000).select((F.col("id") % 4).alias("k"), F.lit(1).alias("v"))
    assert split.sample_rows(df, 200, "k").count() == 200
    equal = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(2).alias("v"))
    sides = {r["is_test"]: r["count"] for r in split.train_test_split(equal, None).groupBy("is_test").count().collect()}
    assert sides == {True: 200, False: 800}
    folds = split.assign_folds(equal, None, folds=5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [200] * 5


@pytest.mark.parametrize("n", [100, 200])
def test_noise_shares_no_information(spark, n):
    df = spark.range(n).select(*[F.rand(s).alias(f"f{s}") for s in range(4)], (F.rand(99) * 1000).alias("y"), F.concat(F.lit("t"), "id").alias("name"))
    df = spark.createDataFrame(df.collect(), df.schema)
    assert leakage.mutual_information_risks(df, "y").count() == 0
    assert leakage.mutual_information_risks(df, "name").count() == 0


def test_equal_columns_of_a_wide_shuffled_table(spark):
    df = spark.range(300).select(*[(F.col("id") * (i + 3) % 101).alias(f"c{i}") for i in range(120)], (F.col("id") * 3 % 101).alias("copy")).repartition(7)
    assert ("c0", "copy") in stats.duplicate_column_pairs(df)


def test_large_integers_are_not_compared_as_doubles(spark):
    df = spark.range(40).select((F.lit(2**60) + 3 * F.col("id")).alias("f"), (F.lit(2**60) + 3 * F.col("id") + 1).alias("y"))
    assert leakage.duplicate_target_stats(df, "y").first()["equal_rows"] == 0


def test_a_replacement_character_is_good_utf8(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("a,b\ncafé,�\n", encoding="utf-8")
    bad.write_bytes("a,b\ncafé,x\n".encode("latin-1"))
    assert read_csv(spark, str(good)).first()["a"] == "café"
    assert read_csv(spark, str(bad)).first()["a"] == "café"


def test_words_of_names_in_any_script(spark):
    df = spark.createDataFrame([("année", "durée")], "a string, b string")
    assert df.select(names.shares_token(F.col("a"), F.col("b"))).first()[0] is False


def test_a_dominant_infinity_is_found_with_sketches(spark):
    df = spark.range(100).select(F.when(F.col("id") < 97, float("inf")).otherwise(F.col("id").cast("double")).alias("x"), (F.col("id") % 2).alias("y"))
    found = stats.approximate_distinct(df, [c for c in columns_of(df) if c.name == "x"], {"x": 98.0})
    assert (found["x"]["dominant_count"], found["x"]["dominant_value"]) == (97, "Infinity")
