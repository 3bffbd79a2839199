"""The registered queries: contract, and a few of them against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
import tools_check

SF_DIR = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
@pytest.mark.parametrize("name", ["profile_numeric", "missing_findings", "stratified_split", "cv_folds", "risk_router", "roc_auc"])
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in tools_check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    assert tools_check.compare(spark, con, SF_DIR, name).startswith("ok")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_entry_finds_the_planted_problems(spark):
    categories = {r["category"] for r in contract.entry(spark).collect()}
    assert {"constant_column", "duplicate_columns", "infinite_values", "mixed_type_column", "target_missing_values"} <= categories
