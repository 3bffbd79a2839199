"""Metadata-sized tables as local relations (no tasks, no Python serialisation)."""

from __future__ import annotations

from typing import Any, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_TYPES = {
    "string": pa.string(),
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "map": pa.map_(pa.string(), pa.string()),
    "strings": pa.list_(pa.string()),
    "doubles": pa.list_(pa.float64()),
}


def small_table(spark: SparkSession, rows: Iterable[dict[str, Any]], schema: dict[str, str]) -> DataFrame:
    """Build a DataFrame from rows whose number is bounded by columns, rules or models."""
    fields = pa.schema([(name, _TYPES[kind]) for name, kind in schema.items()])
    data = [{name: row.get(name) for name in schema} for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, schema=fields))
