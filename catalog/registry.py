"""Query registry and the views the queries run on.

The supplied tables are clean, so quality checks run on views that carry gaps,
infinities, copies and constants. A view is one SQL text that both engines run.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that must give the same rows."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, read from its files by every pass."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        _TABLES[key].createOrReplaceTempView(_view_name(sf_dir, name))
    return _TABLES[key]


def _view_name(sf_dir: str, name: str) -> str:
    return f"{name}_" + re.sub(r"\W", "_", sf_dir)


VIEWS = {
    # Gaps, NaN, infinities, copied rows and columns, constants, text dates and mixed text.
    "dirty_lineitem": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
               CASE WHEN l_quantity = 50 AND l_linenumber = 7 THEN CAST('Infinity' AS DOUBLE)
                    WHEN l_quantity = 1 AND l_linenumber = 7 THEN CAST('-Infinity' AS DOUBLE)
                    ELSE l_extendedprice END AS l_extendedprice,
               CASE WHEN l_discount > 0 THEN l_discount END AS l_discount,
               CASE WHEN l_tax > 0.02 THEN CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) ELSE l_tax END END AS l_tax,
               CASE WHEN l_quantity = 50 THEN l_extendedprice * 100 ELSE l_extendedprice END AS shipping_fee,
               l_quantity AS quantity_copy,
               CASE WHEN l_linenumber > 6 THEN NULL ELSE l_returnflag END AS l_returnflag,
               CASE WHEN l_quantity = 50 THEN 'Z' ELSE l_returnflag END AS l_returnflag_copy,
               l_linestatus,
               CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS return_state,
               CAST(CAST(l_shipdate AS DATE) AS STRING) AS ship_day,
               'erp' AS source_system,
               CASE WHEN l_quantity = 50 THEN 'late' ELSE 'on time' END AS delivery,
               CASE l_linenumber WHEN 1 THEN 'n/a' WHEN 2 THEN 'true' WHEN 3 THEN '1.5' WHEN 4 THEN '2024-01-31' ELSE '7' END AS mixed_cell,
               concat('s', CAST(l_suppkey AS STRING)) AS supplier_code,
               concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '/', CAST(l_partkey AS STRING), '/',
                      CAST(l_suppkey AS STRING), '/', CAST(CAST(l_quantity AS INT) AS STRING)) AS row_ref,
               l_linestatus = 'F' AS is_final, l_shipdate
        FROM (SELECT * FROM {lineitem} UNION ALL SELECT * FROM {lineitem} WHERE l_quantity = 50)
    """,
    # Labelled documents with text features.
    "labelled_documents": """
        SELECT d.doc_id, d.lang, d.source, d.n_chars, length(d.text) AS text_length, l.quality, l.toxic,
               CASE WHEN d.n_chars >= 400 THEN 1 ELSE 0 END AS guess,
               CAST(d.n_chars AS DOUBLE) / (d.n_chars + 1000) AS score
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
    """,
    # Orders with a forecast of the price made from the order priority.
    "forecast_orders": """
        SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate,
               CASE WHEN o_totalprice < 2000 THEN 0 ELSE o_totalprice END AS actual_price,
               150000 + 20000 * CAST(substr(o_orderpriority, 1, 1) AS INT) + 1000 * length(o_orderstatus) AS forecast_price
        FROM {orders}
    """,
    # One audit per customer, summed up from the customer's orders.
    "customer_audits": """
        SELECT concat('c', CAST(o_custkey AS STRING)) AS audit_id, 'o_orderstatus' AS target_column,
               CASE WHEN count(DISTINCT o_orderstatus) = 2 THEN 'binary_classification'
                    WHEN count(DISTINCT o_orderstatus) > 2 THEN 'multiclass_classification' ELSE 'regression' END AS problem_type,
               count(*) < 8 AS problem_needs_review, 'Few orders.' AS problem_reason,
               round(CAST(100 AS DOUBLE) - min(o_totalprice) * 200 / max(o_totalprice), 2) AS quality_score,
               CASE WHEN max(o_totalprice) > 490000 THEN 'critical' WHEN max(o_totalprice) > 480000 THEN 'high'
                    WHEN max(o_totalprice) > 460000 THEN 'medium' WHEN max(o_totalprice) > 430000 THEN 'low' ELSE 'none' END AS leakage_severity,
               CAST(CASE WHEN max(o_totalprice) > 430000 THEN count(*) ELSE 0 END AS BIGINT) AS leakage_count,
               CASE WHEN max(o_orderpriority) = min(o_orderpriority) THEN 'severe' WHEN count(*) > 14 THEN 'high'
                    WHEN count(*) > 12 THEN 'moderate' ELSE 'low' END AS imbalance_severity,
               CAST(CASE WHEN count(*) > 13 THEN 4 WHEN count(*) > 11 THEN 1 ELSE 0 END AS BIGINT) AS optional_failures
        FROM {orders} GROUP BY o_custkey
    """,
    # A reviewer's decision on each audit, read off the customer's orders.
    "customer_decisions": """
        SELECT concat('c', CAST(o_custkey AS STRING)) AS audit_id,
               CASE WHEN count(*) > 14 THEN ' Approved ' WHEN count(*) > 12 THEN 'needs_fix' WHEN count(*) > 10 THEN 'approved_with_known_risks'
                    WHEN count(*) > 8 THEN 'not_ready_pending_review' WHEN count(*) > 6 THEN 'unknown' END AS final_human_decision,
               max(o_orderstatus) = 'P' AS approved_for_modeling, CAST(CASE WHEN count(*) > 9 THEN 0 ELSE 2 END AS BIGINT) AS pending
        FROM {orders} GROUP BY o_custkey HAVING count(*) > 4
    """,
}
_SOURCES = {
    "customer_audits": ["orders"], "customer_decisions": ["orders"],
    "dirty_lineitem": ["lineitem"], "labelled_documents": ["documents", "labels"], "forecast_orders": ["orders"],
}

# Columns of the dirty view by type group, and those stored as double.
NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
           "l_tax", "shipping_fee", "quantity_copy"]
DOUBLES = NUMBERS[4:]
STRINGS = ["l_returnflag", "l_returnflag_copy", "l_linestatus", "return_state", "ship_day", "source_system",
           "delivery", "mixed_cell", "supplier_code", "row_ref"]
OTHERS = ["is_final", "l_shipdate"]
ALL = NUMBERS + STRINGS + OTHERS
GROUP = {c: "numeric" for c in NUMBERS} | {c: "categorical" for c in STRINGS} | {"is_final": "boolean", "l_shipdate": "datetime"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the whole of its source tables."""
    for t in _SOURCES[name]:
        table(spark, sf_dir, t)
    # Named views stay registered: passing a DataFrame to spark.sql drops its view and with it the kept data.
    return spark.sql(VIEWS[name].format(**{t: _view_name(sf_dir, t) for t in _SOURCES[name]}))


def view_sql(name: str) -> str:
    return VIEWS[name].format(**{t: t for t in _SOURCES[name]})


def dirty(columns: list[str] = ALL) -> str:
    """CTEs: `raw` is the dirty view, `d` has NaN as null."""
    cells = ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" if c in DOUBLES else c for c in columns)
    return f"WITH raw AS ({view_sql('dirty_lineitem')}), d AS (SELECT {cells} FROM raw)"


def finite(c: str) -> str:
    return f"CASE WHEN isinf({c}) THEN NULL ELSE {c} END" if c in DOUBLES else c


def each(columns: list[str], make: Callable[[str], str]) -> str:
    """One SELECT per column, stacked."""
    return " UNION ALL ".join(make(c) for c in columns)
