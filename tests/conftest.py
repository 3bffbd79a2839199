"""One local session and the small labelled tables used across the tests."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "2").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def classification_df(spark):
    cities = ["north", "south", "west"]
    rows = [(18 + i % 42, 20000 + i * 1500, cities[i % 3], 1 if i < 25 else 0) for i in range(40)]
    return spark.createDataFrame(rows, "age int, income int, city string, approved int")


@pytest.fixture(scope="session")
def multiclass_df(spark):
    bands = ["low"] * 25 + ["medium"] * 20 + ["high"] * 15
    rows = [(18 + i % 50, 20000 + i * 900, f"c{i % 4}", b) for i, b in enumerate(bands)]
    return spark.createDataFrame(rows, "age int, income int, city string, risk_band string")


@pytest.fixture(scope="session")
def imbalanced_df(spark):
    rows = [(20 + i, 30000 + 10 * i, f"c{i % 3}", 0 if i < 3 else 1) for i in range(50)]
    return spark.createDataFrame(rows, "age int, income int, city string, approved int")


@pytest.fixture(scope="session")
def regression_df(spark):
    rows = [(i * 0.2, 50.0 + (i * 7) % 50, 8 * i * 0.2 + 20 + ((i * 13) % 7 - 3) * 0.5) for i in range(50)]
    return spark.createDataFrame(rows, "hours_studied double, attendance_percent double, score double")


@pytest.fixture(scope="session")
def leaky_df(spark):
    rows = []
    for i in range(30):
        math, science = 40 + (i * 7) % 60, 40 + (i * 11) % 60
        result = "Pass" if math + science >= 100 else "Fail"
        rows.append((f"S{i:03d}", math, science, math + science, result, result))
    return spark.createDataFrame(rows, "student_id string, math int, science int, total int, result string, target_copy string")


@pytest.fixture(scope="session")
def messy_df(spark):
    rows = [(f"r{i}", None if i in (2, 5) else float(i), 10, i % 4, i % 2) for i in range(10)]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "record_id string, feature_a double, feature_b int, feature_c int, label int")


@pytest.fixture(scope="session")
def high_cardinality_df(spark):
    rows = [(f"code-{i}", 20 + i % 30, ["a", "b", "c"][i % 3], 1 if i < 45 else 0) for i in range(80)]
    return spark.createDataFrame(rows, "customer_code string, age int, segment string, target int")


@pytest.fixture(scope="session")
def datetime_df(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(days=i), 10.0 + i, ["x", "y", "z"][i % 3], 1 if i % 3 == 0 else 0) for i in range(36)]
    return spark.createDataFrame(rows, "signup_date timestamp, usage_minutes double, plan string, churned int")


@pytest.fixture(scope="session")
def infinite_df(spark):
    inf = float("inf")
    rows = [(1.0, 1.0, 0), (inf, 2.0, 1), (3.0, -inf, 0), (4.0, 4.0, 1), (5.0, 5.0, 0), (6.0, 6.0, 1)]
    return spark.createDataFrame(rows, "feature_a double, feature_b double, target int")


@pytest.fixture(scope="session")
def missing_target_df(spark):
    rows = [(i, f"v{i}", None if i in (1, 4) else float(i % 2)) for i in range(6)]
    return spark.createDataFrame(rows, "feature_a int, feature_b string, target double")
