"""The column facts table: one row per column, gathered in as few passes as the checks need."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F

from gaugewell.functions import cells
from gaugewell.functions.small import small_table
from gaugewell.operators import stats
from gaugewell.operators.schema import ColumnInfo, columns_of

_SCHEMA = {
    "position": "long", "column": "string", "dtype": "string", "type_group": "string", "is_target": "boolean",
    "target": "string", "n_rows": "long", "n_present": "long", "n_missing": "long", "n_valid": "long",
    "pos_inf": "long", "neg_inf": "long", "mean": "double", "std": "double", "min": "double", "max": "double",
    "g1": "double", "g2": "double", "q25": "double", "median": "double", "q75": "double", "n_distinct": "long",
    "dominant_count": "long", "dominant_value": "string", "n_rare": "long", "int_like": "boolean",
    "bool_like": "boolean", "n_true": "long", "n_false": "long", "n_nonblank": "long", "n_parsed": "long",
    "ts_min": "string", "ts_max": "string", "n_int": "long", "n_float": "long", "n_bool": "long",
    "n_timestamp": "long", "n_text": "long", "lower": "double", "upper": "double", "n_outliers": "long",
}


@dataclass
class Facts:
    """Facts of one table. `by_column` and `table` hold the same, metadata-sized data."""

    df: DataFrame
    target: str | None
    n_rows: int
    by_column: dict[str, dict[str, Any]]
    table: DataFrame
    kept: dict[str, Any] = field(default_factory=dict)  # small results about the whole table, shared by all its targets

    def __getitem__(self, column: str) -> dict[str, Any]:
        return self.by_column[column]

    def once(self, name: str, make: Callable[[], Any]) -> Any:
        """A result that does not depend on the target, computed the first time it is asked for."""
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]

    def for_target(self, target: str | None) -> Facts:
        """The same facts seen from another target; nothing is read again."""
        by_column = {n: f | {"is_target": n == target, "target": target} for n, f in self.by_column.items()}
        return Facts(self.df, target, self.n_rows, by_column, _table(self.df, by_column), self.kept)


def _table(df: DataFrame, by_column: dict[str, dict[str, Any]]) -> DataFrame:
    return small_table(df.sparkSession, by_column.values(), _SCHEMA).withColumns(
        {
            "missing_percent": cells.percent(F.col("n_missing"), F.col("n_rows")),
            "unique_percent": cells.percent(F.col("n_distinct"), F.col("n_rows")),
            "dominant_percent": cells.percent(F.col("dominant_count"), F.col("n_rows")),
        }
    )


def _outliers(df: DataFrame, infos: list[ColumnInfo], found: dict[str, dict[str, Any]], factor: float, least: int):
    """Bounds from the exact quartiles; cells outside them are counted in one pass where the pass for the quartiles could not."""
    dtypes = {c.name: c.dtype for c in infos}
    outside = {}
    for name, f in found.items():
        if f.get("q25") is None or f["n_valid"] < least or f["min"] == f["max"] or f["q25"] == f["q75"]:
            continue
        spread = f["q75"] - f["q25"]
        f["lower"], f["upper"] = f["q25"] - factor * spread, f["q75"] + factor * spread
        if "n_outside" in f:
            f["n_outliers"] = f.pop("n_outside")
            continue
        x = cells.finite(name, dtypes[name])
        outside[name] = (x < f["lower"]) | (x > f["upper"])
    if outside:
        for name, e in stats.reduce_cells(df, outside, {"n_outliers": "count_if(x)"}).items():
            found[name] |= e


def gather(
    df: DataFrame, target: str | None = None, need: set[str] = frozenset(), only: list[str] | None = None,
    rare_percent: float = 1.0, iqr_multiplier: float = 1.5, outlier_min_values: int = 10, exact_distinct: bool = True,
) -> Facts:
    """Collect the facts named in `need`.

    numeric, infinite, labels, dates, classes come from one scan; quantiles add
    the exact quartiles, outliers the bounds and counts, frequency the distinct,
    dominant and rare counts. With `exact_distinct` off, numeric and text columns
    other than the target take their distinct count from a sketch and are not
    shuffled; dominant texts come from a frequent-items sketch and an exact count.
    """
    infos = columns_of(df, only)
    sketched = [c for c in infos if c.group == "numeric" and c.name != target and not exact_distinct and "frequency" in need]
    hinted = [c for c in infos if c.group == "categorical" and c.name != target and not exact_distinct and "frequency" in need]
    want = set(need) | ({"quantiles"} if "outliers" in need or sketched else set())
    # What is read off a text depends on the text alone, so where distinct texts are counted they are read once each.
    told = [c for c in infos if c.group in ("categorical", "boolean") and c not in hinted and "frequency" in need]
    scanned = [c for c in infos if c not in told]
    n_rows, found = stats.scan(df, want, scanned)
    n_rows = n_rows if scanned else df.count()
    found |= {c.name: {"n_rows": n_rows, "n_present": 0, "n_missing": n_rows} for c in told}
    if "quantiles" in want:
        numbers = {n: f for n, f in found.items() if f.get("n_valid")}
        quartiles = stats.exact_quantiles(df, [0.25, 0.5, 0.75], numbers, fence=iqr_multiplier if "outliers" in need else None) if numbers else {}
        for name, q in quartiles.items():
            found[name] |= dict(zip(("q25", "median", "q75"), q))
    if "outliers" in need:
        _outliers(df, infos, found, iqr_multiplier, outlier_min_values)
    if "frequency" in need:
        counted = [c for c in infos if c not in sketched and c not in hinted]
        if hinted:
            for name, f in stats.heavy_hitters(df, hinted, n_rows, rare_percent).items():
                found[name] |= f
        for name, f in stats.frequency_summary(df, counted, n_rows, rare_percent, want | {"rows"}).items():
            found[name] |= f
            found[name]["n_missing"] = found[name]["n_rows"] - found[name]["n_present"]
        if sketched:
            medians = {c.name: found[c.name].get("median") for c in sketched}
            for name, f in stats.approximate_distinct(df, sketched, medians).items():
                found[name] |= f
    for c in infos:
        f = found[c.name]
        f |= {
            "position": c.position, "column": c.name, "dtype": c.dtype.simpleString(), "type_group": c.group,
            "is_target": c.name == target, "target": target, "n_rows": n_rows,
        }
        if "labels" in need:
            f["bool_like"] = c.group == "boolean" or stats.is_bool_like(f.get("label_mask"))
            f["int_like"] = True if c.group == "boolean" else bool(f.get("int_like"))
    return Facts(df, target, n_rows, found, _table(df, found))
