"""Schema walk and target resolution."""

from __future__ import annotations

from dataclasses import dataclass
from difflib import get_close_matches

from pyspark.sql import DataFrame, functions as F, types as T

from gaugewell.errors import AuditError, TargetError
from gaugewell.functions import cells
from gaugewell.functions.small import small_table


@dataclass(frozen=True)
class ColumnInfo:
    position: int
    name: str
    dtype: T.DataType
    group: str


def columns_of(df: DataFrame, only: list[str] | None = None) -> list[ColumnInfo]:
    """One entry per column, in schema order."""
    infos = [
        ColumnInfo(i, f.name, f.dataType, cells.type_group(f.dataType)) for i, f in enumerate(df.schema.fields)
    ]
    return infos if only is None else [c for c in infos if c.name in set(only)]


def check_structure(df: DataFrame) -> DataFrame:
    """Reject a table without rows or columns, or with repeated or blank column names."""
    names = df.columns
    if not names:
        raise AuditError("The table has no columns.")
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise AuditError(f"Repeated column names: {repeated}")
    if any(not n.strip() for n in names):
        raise AuditError("The table has blank column names.")
    if df.isEmpty():
        raise AuditError("The table has no rows.")
    return df


def resolve_target(df: DataFrame, target: str) -> str:
    """Exact name, then the trimmed name, then a unique case-insensitive match."""
    if target is None or not str(target).strip():
        raise TargetError("A target column is required.")
    names = df.columns
    for candidate in (str(target), str(target).strip()):
        if names.count(candidate) == 1:
            return candidate
    folded = str(target).strip().lower()
    hits = [n for n in names if n.strip().lower() == folded]
    if len(hits) == 1:
        return hits[0]
    close = get_close_matches(str(target).strip(), names, n=3)
    hint = f" Close names: {close}." if close else ""
    raise TargetError(f"Target column '{target}' is not in the table.{hint}")


def validate_target(df: DataFrame, target: str) -> str:
    """Resolve the target and require at least two distinct non-null values (one aggregate)."""
    name = resolve_target(df, target)
    info = columns_of(df, [name])[0]
    value = cells.text_key(name, info.dtype)
    row = df.agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if row["n"] == 0:
        raise TargetError(f"Target column '{name}' has only missing values.")
    if row["lo"] == row["hi"]:
        raise TargetError(f"Target column '{name}' needs at least two distinct values.")
    return name


def require_features(df: DataFrame, target: str) -> None:
    if len(df.columns) < 2:
        raise AuditError(f"The table holds no feature column next to '{target}'.")


def type_groups(df: DataFrame, dates: list[str] = ()) -> DataFrame:
    """(position, column, dtype, type_group); columns in `dates` are string columns found to hold dates."""
    rows = [
        {
            "position": c.position,
            "column": c.name,
            "dtype": c.dtype.simpleString(),
            "type_group": "datetime" if c.name in dates else c.group,
        }
        for c in columns_of(df)
    ]
    return small_table(
        df.sparkSession, rows, {"position": "long", "column": "string", "dtype": "string", "type_group": "string"}
    )
