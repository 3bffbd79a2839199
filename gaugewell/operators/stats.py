"""Shared column statistics.

Three kinds of pass over the data feed every check:

* `scan`       cells are turned into (column, value) rows by Expand and reduced
               per column with map-side combining. Numeric, text and datetime
               columns go in separate passes over disjoint columns;
* `quantiles`  exact order statistics: a mergeable sketch in the scan gives brackets,
               a second scan counts the values inside and proves the ranks;
* `frequency`  one (column, value) count, again combined on the map side; a
               long text counts under its digest and is fetched only if shown.

Only results with one row per column reach the driver.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugewell.functions import cells, dates
from gaugewell.operators.schema import ColumnInfo, columns_of

CHUNK = 100  # columns per pass; below the group count at which object aggregation starts to sort
SKETCH = 8_192  # size of a quantile sketch; its rank error stays below half of SLACK in 99 of 100 columns
SLACK = 0.0014  # share of the rows by which a bracket reaches beyond the sketch's answer on each side
GRID = [i / 200 for i in range(1, 200)]  # quantiles read off a sketch where the wanted ranks are not known beforehand
BRACKET_LIMIT = 1_000_000  # distinct values a bracket may hold when it is sorted
PICKED = 60  # intervals compared in one projection; the JVM leaves longer methods uncompiled

# Labels read as booleans.
BOOL_LABELS = ["true", "yes", "y", "1", "positive", "pos", "false", "no", "n", "0", "negative", "neg"]

# Text classes for the mixed-type check, tried in this order.
INT_SHAPE = "^[+-]?[0-9]+$"
FLOAT_SHAPE = "^[+-]?([0-9]+[.][0-9]*|[.][0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$"
TEXT_CLASSES = ["int", "float", "bool", "timestamp", "text"]


def text_class(value: Column) -> Column:
    """Which literal a string cell holds: int, float, bool, timestamp or text."""
    t = F.trim(value)
    return (
        F.when(value.isNull(), F.lit(None))
        .when(t.rlike(INT_SHAPE), "int")
        .when(t.rlike(FLOAT_SHAPE), "float")
        .when(F.lower(t).isin("true", "false"), "bool")
        .when(dates.date_shaped(value), "timestamp")
        .otherwise("text")
    )


def is_bool_like(mask: int | None) -> bool:
    """Exactly two labels seen, both boolean-like (bit 0 stands for any other label)."""
    return mask is not None and not mask & 1 and mask.bit_count() == 2


def reduce_cells(
    df: DataFrame, exprs: dict[str, Column], aggs: dict[str, str | Column], derive: dict[str, Column] | None = None
) -> dict[str, dict[str, Any]]:
    """Apply the same aggregates (over `x`) to every cell expression; one result row per column."""
    found: dict[str, dict[str, Any]] = {}
    names = list(exprs)
    reducers = [(F.expr(a) if isinstance(a, str) else a).alias(k) for k, a in aggs.items()]
    for start in range(0, len(names), CHUNK):
        part = names[start : start + CHUNK]
        labels = [f"c{i}" for i in range(len(part))]
        long = df.select(*[exprs[n].alias(c) for n, c in zip(part, labels)]).unpivot([], labels, "pos", "x")
        if derive:
            long = long.withColumns(derive)
        for row in long.groupBy("pos").agg(*reducers).collect():
            entry = row.asDict()
            found[part[int(entry.pop("pos")[1:])]] = entry
    return found


_FINITE = "CASE WHEN abs({0}) < double('infinity') THEN {0} END"


def _numeric_aggs(want: set[str]) -> dict[str, str]:
    out = {"n_rows": "count(1)", "n_present": "count(x)"}
    if want & {"numeric", "infinite"}:
        out |= {
            "n_valid": "count(v)", "pos_inf": "count_if(x = double('infinity'))",
            "neg_inf": "count_if(x = double('-infinity'))",
        }
    if "numeric" in want:
        out |= {"min": "min(v)", "max": "max(v)"}
    if "numeric" in want:
        out |= {"mean": "avg(v)", "std": "stddev_samp(v)", "g1": "skewness(v)", "g2": "kurtosis(v)"}
    if "labels" in want:
        one, zero = BOOL_LABELS.index("1") + 1, BOOL_LABELS.index("0") + 1
        out["int_like"] = "bool_and(v % 1 = 0)"
        out["label_mask"] = (
            f"bit_or(CASE WHEN x = 1 THEN {1 << one} WHEN x = 0 THEN {1 << zero} WHEN x IS NOT NULL THEN 1 END)"
        )
    return out


def points_around(probs: list[float]) -> list[float]:
    """Shares of the rows between which the quantiles at `probs` lie for sure if the sketch keeps within its error."""
    return sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-2 * SLACK, 2 * SLACK)})


def _sketches(df: DataFrame, exprs: dict[str, Column], points: list[float]) -> dict[str, dict[str, Any]]:
    """Counts, range and approximate quantiles at `points` per numeric cell expression.

    Sketches are kept by column in one row: an aggregate of objects is not compiled with the scan, so turning cells into
    rows first would only cost, and the moments, which gain from being compiled, have a pass of their own.
    """
    found: dict[str, dict[str, Any]] = {}
    names = list(exprs)
    for start in range(0, len(names), CHUNK):
        part = names[start : start + CHUNK]
        present = [F.count(exprs[n]).alias(f"n{i}") for i, n in enumerate(part)]
        sketches = [F.kll_sketch_agg_double(F.when(F.abs(exprs[n]) < cells.INF, exprs[n]), F.lit(SKETCH)).alias(f"s{i}") for i, n in enumerate(part)]
        asked = F.lit([0.0, *points, 1.0])
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), *present, *sketches).select("n_rows", *[
            F.struct(F.col(f"n{i}").alias("n_present"), F.kll_sketch_get_n_double(f"s{i}").alias("n_valid"),
                     F.when(F.kll_sketch_get_n_double(f"s{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", asked)).alias("q")).alias(f"c{i}")
            for i in range(len(part))
        ]).first()
        for i, n in enumerate(part):
            entry = found[n] = {"n_rows": row["n_rows"], "points": points} | row[f"c{i}"].asDict()
            q = entry.pop("q") or [None] * (len(points) + 2)
            entry |= {"min": q[0], "brackets": q[1:-1], "max": q[-1]}
    return found


def _text_aggs(want: set[str]) -> tuple[dict[str, str], dict[str, Column]]:
    out, derive = {"n_rows": "count(1)", "n_present": "count(x)"}, {}
    if "numeric" in want:
        out |= {"n_true": "count_if(x = 'true')", "n_false": "count_if(x = 'false')"}
    if "labels" in want:
        labels = ", ".join(f"'{w}'" for w in BOOL_LABELS)
        out["label_mask"] = f"bit_or(shiftleft(1, CAST(array_position(array({labels}), lower(trim(x))) AS INT)))"
    if "dates" in want:
        derive["ts"] = dates.parse_date(F.col("x"))
        out |= {"n_nonblank": "count_if(trim(x) <> '')", "n_parsed": "count(ts)"}
        out |= {"ts_min": "CAST(min(ts) AS STRING)", "ts_max": "CAST(max(ts) AS STRING)"}
    if "classes" in want:
        derive["kind"] = text_class(F.col("x"))
        out |= {f"n_{k}": f"count_if(kind = '{k}')" for k in TEXT_CLASSES}
    return out, derive


def scan(
    df: DataFrame, want: set[str], columns: list[ColumnInfo] | None = None, probs: list[float] = (0.25, 0.5, 0.75),
    points: list[float] | None = None,
) -> tuple[int, dict[str, dict[str, Any]]]:
    """Row count and, per column, the wanted single-pass statistics; sketches are read at `points`, by default around `probs`."""
    infos = columns_of(df) if columns is None else columns
    by_kind: dict[str, dict[str, Column]] = {"number": {}, "text": {}, "time": {}, "other": {}}
    for c in infos:
        value = cells.present(c.name, c.dtype)
        if c.group == "numeric":
            by_kind["number"][c.name] = value.cast("double")
        elif c.group in ("categorical", "boolean"):
            by_kind["text"][c.name] = value.cast("string")
        elif c.group == "datetime":
            by_kind["time"][c.name] = value.cast("timestamp")
        else:
            by_kind["other"][c.name] = value.isNotNull()
    found: dict[str, dict[str, Any]] = {}
    if by_kind["number"]:
        finite = {"v": F.expr(_FINITE.format("x"))}
        if "quantiles" in want:
            found |= _sketches(df, by_kind["number"], points_around(list(probs)) if points is None else points)
        if "quantiles" not in want or want & {"numeric", "labels", "infinite"}:
            for name, entry in reduce_cells(df, by_kind["number"], _numeric_aggs(want - {"quantiles"}), finite).items():
                found[name] = found.get(name, {}) | entry
    if by_kind["text"]:
        found |= reduce_cells(df, by_kind["text"], *_text_aggs(want))
    counts = {"n_rows": "count(1)", "n_present": "count(x)"}
    if by_kind["time"]:
        times = {"n_parsed": "count(x)", "ts_min": "CAST(min(x) AS STRING)", "ts_max": "CAST(max(x) AS STRING)"}
        found |= reduce_cells(df, by_kind["time"], counts | (times if "dates" in want else {}))
    if by_kind["other"]:
        found |= reduce_cells(df, by_kind["other"], counts | {"n_present": "count_if(x)"})
    found = {c.name: found.get(c.name, {"n_rows": 0, "n_present": 0}) for c in infos}
    for entry in found.values():
        entry["n_missing"] = entry["n_rows"] - entry["n_present"]
    for c in infos:
        if "labels" in want and c.group == "numeric" and (cells.is_float(c.dtype) or "decimal" in c.dtype.simpleString()):
            found[c.name]["label_mask"] = None  # 0.0 and 1.0 are not label texts
    n_rows = next((e["n_rows"] for e in found.values()), 0)
    return n_rows, found


def fingerprints(df: DataFrame, columns: list[ColumnInfo]) -> dict[str, int]:
    """A mergeable hash per column that depends on which row holds which cell.

    Every column of a row is hashed with the same digest of the row's content, so
    equal columns get equal fingerprints whatever the order of the rows is.
    """
    digest = cells.row_digest([(f.name, f.dataType) for f in df.schema.fields])
    source = df.select("*", digest[0].alias("__rid"))
    exprs = {}
    for c in columns:
        cell = cells.text(c.name, c.dtype) if c.group == "unsupported" else cells.present(c.name, c.dtype)
        exprs[c.name] = F.xxhash64(cell, cell.isNull(), F.col("__rid"))
    return {n: e["h"] for n, e in reduce_cells(source, exprs, {"h": "bit_xor(x)"}).items()}


# --------------------------------------------------------------------------- quantiles


@dataclass
class _Rank:
    """One order statistic of a column (from 0) and the bracket of values that holds it."""

    column: str
    rank: int
    lo: float
    hi: float
    value: float | None = None


@dataclass
class _Fence:
    """Outlier bounds of a column: the intervals in which they must lie, then the bounds and the cells beyond them."""

    ranks: list[tuple[_Rank, _Rank, float]]  # low and high neighbour and weight of the first and the third quartile
    factor: float
    n_valid: int
    n_outside: int | None = None

    def intervals(self) -> list[tuple[float, float]]:
        (a, b, _), (c, d, _) = self.ranks
        f, (lo1, hi1, lo3, hi3) = self.factor, (a.lo, b.hi, c.lo, d.hi)
        ends = [((1 + f) * lo1 - f * hi3, (1 + f) * hi1 - f * lo3), ((1 + f) * lo3 - f * hi1, (1 + f) * hi3 - f * lo1)]
        pad = 1e-9 * max(abs(x) for e in ends for x in e)
        return [(lo - pad, hi + pad) for lo, hi in ends]


def _between(a: float, b: float, weight: float) -> float:
    return a if a == b else a + (b - a) * weight


def _merged(intervals: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Disjoint intervals covering the given ones."""
    out: list[list[float]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _bracketed(x: str, intervals: list[tuple[float, float]]) -> str:
    """SQL that keeps values inside an interval and maps each gap below one to a stand-in inside the gap."""
    arms, previous = [], None
    for lo, hi in intervals:
        gap = "double('-infinity')" if previous is None else f"{previous / 2 + lo / 2!r}D"
        arms.append(f"WHEN {x} < {lo!r}D THEN {gap} WHEN {x} <= {hi!r}D THEN {x}")
        previous = hi
    return f"CASE {' '.join(arms)} END"


def _batches(sizes: list[int], most: int) -> list[list[int]]:
    """Places in order, in runs whose sizes add up to at most `most`; a larger one stands alone."""
    out: list[list[int]] = []
    for i, size in enumerate(sizes):
        if not out or sum(sizes[j] for j in out[-1]) + size > most:
            out.append([])
        out[-1].append(i)
    return out


class _LostRank(Exception):
    """A bracket does not hold the rank it was made for."""


def _narrow(df: DataFrame, infos: dict[str, ColumnInfo], ranks: list[_Rank], limit: int) -> list[_Rank]:
    """Shrink brackets that hold more than `limit` distinct values, by a sketch of what is inside; returns those shrunk."""
    aggs = []
    for i, r in enumerate(ranks):
        x = cells.finite(r.column, infos[r.column].dtype)
        inside = F.when(x.between(r.lo, r.hi), x)
        sketch = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(inside, F.lit(SKETCH)), F.lit(GRID))
        aggs += [
            F.count(F.when(x < r.lo, 1)).alias(f"b{i}"), F.count(inside).alias(f"i{i}"),
            F.approx_count_distinct(inside).alias(f"d{i}"), F.when(F.count(inside) > 0, sketch).alias(f"g{i}"),
        ]
    row = df.agg(*aggs).first()
    again = []
    for i, r in enumerate(ranks):
        below, inside, distinct, points = row[f"b{i}"], row[f"i{i}"], row[f"d{i}"], row[f"g{i}"]
        if below > r.rank or below + inside <= r.rank:
            raise _LostRank
        if distinct <= limit:
            continue
        lo, hi = _bracket(GRID, points, r.rank - below, inside, r.lo, r.hi)
        if (lo, hi) != (r.lo, r.hi):
            r.lo, r.hi = lo, hi
            again.append(r)
    return again


def _bracket(points: list[float], values: list[float], rank: int, n: int, lo: float, hi: float) -> tuple[float, float]:
    """Values that hold a rank of n, given a sketch's quantiles at `points` and its error."""
    first, last = bisect.bisect_right(points, rank / n - SLACK) - 1, bisect.bisect_left(points, (rank + 1) / n + SLACK)
    return (values[first] if first >= 0 else lo), (values[last] if last < len(points) else hi)


def _pick(df: DataFrame, infos: dict[str, ColumnInfo], ranks: list[_Rank], fences: dict[str, _Fence]) -> list[_Rank]:
    """Count the values inside all brackets in one pass and read off the ranks; returns the misses.

    The same counts give the cells outside the fences, whose bounds follow from the quartiles found in this very pass.
    """
    by_column: dict[str, dict[int, list[_Rank]]] = {}
    for r in ranks:
        by_column.setdefault(r.column, {}).setdefault(r.rank, []).append(r)
    names = list(by_column)
    spans = {n: _merged([(r.lo, r.hi) for some in by_column[n].values() for r in some]) for n in names}
    kept_spans = {n: _merged(spans[n] + (fences[n].intervals() if n in fences else [])) for n in names}
    labels = [f"c{i}" for i in range(len(names))]
    counted = None
    for part in _batches([len(kept_spans[n]) for n in names], PICKED):
        clean = df.select(*[cells.finite(names[i], infos[names[i]].dtype).alias(labels[i]) for i in part])
        kept = clean.selectExpr(*[f"{_bracketed(labels[i], kept_spans[names[i]])} AS {labels[i]}" for i in part])
        some = (
            kept.unpivot([], [labels[i] for i in part], "pos", "value")
            .where("value IS NOT NULL").groupBy("pos", "value").agg(F.count(F.lit(1)).alias("cnt"))
        )
        counted = some if counted is None else counted.unionByName(some)
    # A window group holds the values inside the brackets of one column, which are bounded.
    asked = {n: sorted(by_column[n]) for n in names}
    most = max(len(a) for a in asked.values())
    listed = ", ".join(f"'c{i}', array({', '.join(f'{k}L' for k in asked[n])})" for i, n in enumerate(names))
    counted = counted.withColumn("upto", F.sum("cnt").over(Window.partitionBy("pos").orderBy("value"))).withColumn("asked", F.expr(f"element_at(map({listed}), pos)"))
    hit = [F.when((F.get("asked", F.lit(j)) < F.col("upto")) & (F.get("asked", F.lit(j)) >= F.col("upto") - F.col("cnt")), F.col("value")) for j in range(most)]
    aggs = [F.max(h).alias(f"v{j}") for j, h in enumerate(hit)]
    if fences:
        counted = counted.withColumns({f"w{j}": F.max(h).over(Window.partitionBy("pos")) for j, h in enumerate(hit)})
        bounds = {}
        for i, n in enumerate(names):
            if n in fences:
                value = [[F.col(f"w{asked[n].index(r.rank)}") for r in pair[:2]] for pair in fences[n].ranks]
                q = [F.when(a == b, a).otherwise(a + (b - a) * F.lit(pair[2])) for (a, b), pair in zip(value, fences[n].ranks)]
                bounds[f"c{i}"] = (q[0] - fences[n].factor * (q[1] - q[0]), q[1] + fences[n].factor * (q[1] - q[0]))
        sides = [F.coalesce(*[F.when(F.col("pos") == c, b[s]) for c, b in bounds.items()]) for s in (0, 1)]
        counted = counted.withColumns({"lower": sides[0], "upper": sides[1]})
        aggs += [F.sum(F.when((F.col("value") >= F.col("lower")) & (F.col("value") <= F.col("upper")), F.col("cnt"))).alias("within")]
    missed: list[_Rank] = []
    rows = {r["pos"]: r for r in counted.groupBy("pos").agg(*aggs).collect()}
    for i, n in enumerate(names):
        row = rows.get(f"c{i}")
        for j, rank in enumerate(asked[n]):
            value = row[f"v{j}"] if row else None
            for r in by_column[n][rank]:
                if value is not None and any(lo <= value <= hi for lo, hi in spans[n]):
                    r.value = value
                else:
                    missed.append(r)
        if row and n in fences and all(r.value is not None for pair in fences[n].ranks for r in pair[:2]):
            fences[n].n_outside = fences[n].n_valid - (row["within"] or 0)
    return missed


def order_statistics(
    df: DataFrame, wanted: dict[str, set[int]], stats: dict[str, dict[str, Any]], limit: int | None = None,
    fences: dict[str, _Fence] | None = None, ranks: list[_Rank] | None = None,
) -> dict[str, dict[int, float]]:
    """Exact values at ranks (from 0) of numeric columns, given a `scan(..., {"quantiles"})` of them.

    The sketch in `stats` gives brackets that hold the wanted ranks; one more pass counts the distinct values inside them,
    and the counts prove the result. Brackets too wide to sort are narrowed first, and one that missed its rank is widened to
    the column's range and narrowed again, so nothing depends on the sketch's error.
    """
    limit, fences = BRACKET_LIMIT if limit is None else limit, fences or {}
    infos = {c.name: c for c in columns_of(df)}
    ranks = _ranks(wanted, stats) if ranks is None else ranks

    def widen(some: list[_Rank]) -> None:
        for r in some:
            r.lo, r.hi = stats[r.column]["min"], stats[r.column]["max"]

    largest = max((stats[r.column]["n_valid"] for r in ranks), default=0)
    narrow_first, pending = largest * 4 * SLACK > limit, list(ranks)
    while pending:
        busy = pending if narrow_first else []
        while busy:
            try:
                busy = _narrow(df, infos, busy, limit)
            except _LostRank:
                widen(busy)
        # Fences are counted with brackets that came from the first sketch; wider ones would hold too many values.
        pending = _pick(df, infos, pending, {} if narrow_first else fences)
        widen(pending)
        narrow_first = True
    found: dict[str, dict[int, float]] = {}
    for r in ranks:
        found.setdefault(r.column, {})[r.rank] = r.value
    return found


def _ranks(wanted: dict[str, set[int]], stats: dict[str, dict[str, Any]]) -> list[_Rank]:
    out = []
    for name, ranks in wanted.items():
        s = stats[name]
        out += [_Rank(name, r, *_bracket(s["points"], s["brackets"], r, s["n_valid"], s["min"], s["max"])) for r in sorted(ranks)]
    return out


def _neighbours(n: int, p: float) -> tuple[int, int, float]:
    """Ranks on both sides of a linearly interpolated quantile and the weight of the second."""
    at = (n - 1) * p
    low = math.floor(at)
    return low, min(low + 1, n - 1), at - low


def exact_quantiles(
    df: DataFrame, probs: list[float], stats: dict[str, dict[str, Any]], limit: int | None = None, fence: float | None = None
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of numeric columns, exact at any size (see `order_statistics`).

    With `fence`, the number of cells outside that many interquartile ranges of the quartiles comes from the same pass and is put
    into `stats` as `n_outside`, unless brackets had to be narrowed or widened first.
    """
    sides = {name: [_neighbours(s["n_valid"], p) for p in probs] if s.get("n_valid") else [] for name, s in stats.items()}
    ranks = _ranks({name: {r for low, high, _ in found for r in (low, high)} for name, found in sides.items() if found}, stats)
    by_rank = {(r.column, r.rank): r for r in ranks}
    fences = {}
    if fence is not None:
        for name, found in sides.items():
            if found and stats[name]["min"] != stats[name]["max"]:
                quartiles = [found[probs.index(p)] for p in (0.25, 0.75)]
                fences[name] = _Fence([(by_rank[name, a], by_rank[name, b], w) for a, b, w in quartiles], fence, stats[name]["n_valid"])
    values = order_statistics(df, {}, stats, limit, fences, ranks)
    for name, f in fences.items():
        if f.n_outside is not None:
            stats[name]["n_outside"] = f.n_outside
    return {
        name: [_between(values[name][low], values[name][high], w) for low, high, w in found] if found else [None] * len(probs)
        for name, found in sides.items()
    }


def quantiles_of(df: DataFrame, names: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of the named numeric columns (a sketch scan and a counting pass)."""
    infos = [c for c in columns_of(df, names) if c.group == "numeric"]
    if not infos:
        return {}
    _, stats = scan(df, {"quantiles"}, infos, probs)
    return exact_quantiles(df, probs, stats)


def filled_quantiles(
    df: DataFrame, names: list[str], probs: list[float], unfilled: list[str] = ()
) -> tuple[dict[str, float], dict[str, list[float]], dict[str, list[float]]]:
    """(median, quantiles after gaps are filled with it, approximate quantiles at GRID) per numeric column with two finite values
    or more, in two scans.

    The column with m fills of the median M is never made: its value at rank r is the column's own at r if that lies below M, the own
    one at r - m if that lies above M, and M otherwise. Columns in `unfilled` give the quantiles of their finite cells.
    """
    n_rows, found = scan(df, {"quantiles"}, [c for c in columns_of(df, names) if c.group == "numeric"], points=GRID)
    found = {n: s for n, s in found.items() if s.get("n_valid") and s["min"] != s["max"]}
    gaps = {n: 0 if n in unfilled else n_rows - s["n_valid"] for n, s in found.items()}
    middle = {n: _neighbours(s["n_valid"], 0.5) for n, s in found.items()}
    sides = {n: [_neighbours(s["n_valid"] + gaps[n], p) for p in probs] for n, s in found.items()}
    wanted = {
        n: {r for r in (*middle[n][:2], *(k - shift for low, high, _ in sides[n] for k in (low, high) for shift in (0, gaps[n]))) if 0 <= r < s["n_valid"]}
        for n, s in found.items()
    }
    values = order_statistics(df, wanted, found) if found else {}
    medians = {n: _between(values[n][a], values[n][b], w) for n, (a, b, w) in middle.items()}

    def at(n: str, rank: int) -> float:
        own, above = values[n].get(rank), values[n].get(rank - gaps[n])
        if not gaps[n] or (own is not None and own < medians[n]):
            return own
        return above if above is not None and above > medians[n] else medians[n]

    quantiles = {n: [_between(at(n, low), at(n, high), w) for low, high, w in sides[n]] for n in found}
    return medians, quantiles, {n: s["brackets"] for n, s in found.items()}


# --------------------------------------------------------------------------- frequencies


def value_frequency(df: DataFrame, columns: list[ColumnInfo]) -> DataFrame:
    """(column, value, cnt) for every distinct cell, null included.

    Expand plus map-side aggregation: a value that fills a third of the table
    leaves each map task as a single row.
    """
    names = F.array(*[F.lit(c.name) for c in columns])
    keys = [cells.text_key(c.name, c.dtype).alias(f"c{i}") for i, c in enumerate(columns)]
    return (
        df.select(*keys)
        .unpivot([], [f"c{i}" for i in range(len(columns))], "pos", "value")
        .groupBy("pos", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(F.element_at(names, F.substring("pos", 2, 9).cast("int") + 1).alias("column"), "value", "cnt")
    )


def _families(columns: list[ColumnInfo]) -> dict[str, dict[str, Column]]:
    """Grouping keys by storage type: integers and times as long, floats as double, the rest as text."""
    out: dict[str, dict[str, Column]] = {"long": {}, "double": {}, "text": {}}
    for c in columns:
        kind = c.dtype.simpleString()
        if kind in ("tinyint", "smallint", "int", "bigint"):
            out["long"][c.name] = cells.qcol(c.name).cast("long")
        elif c.group == "datetime":
            out["long"][c.name] = F.unix_micros(cells.qcol(c.name).cast("timestamp"))
        elif cells.is_float(c.dtype):
            out["double"][c.name] = cells.present(c.name, c.dtype).cast("double")
        else:
            out["text"][c.name] = cells.text_key(c.name, c.dtype)
    return {k: v for k, v in out.items() if v}


def cell_counts(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """(pos, head, h1, h2, cnt) for the distinct cells of text expressions, null included; pos is `c` and the place in `exprs`.

    A text of up to HEAD characters stands for itself (h1, h2 null); a longer one for its
    first HEAD characters and 128 bits of hashes, so no long text is shuffled.
    """
    keyed = df.select(*[F.struct(*cells.text_digest(x)).alias(f"c{i}") for i, x in enumerate(exprs.values())])
    return (
        keyed.unpivot([], keyed.columns, "pos", "k")
        .groupBy("pos", F.col("k.head").alias("head"), F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def _listed(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def texts_of(df: DataFrame, exprs: dict[str, Column], keys: list[tuple[str, int, int]]) -> dict[tuple[str, int, int], str]:
    """The whole texts of (pos, h1, h2) keys, a few per column: one scan, in which only these texts leave a map task."""
    if not keys:
        return {}
    texts = list(exprs.values())
    used = sorted({int(k[0][1:]) for k in keys})
    rows = df.select(*[F.struct(*cells.text_digest(texts[i])[1:], texts[i].alias("x")).alias(f"c{i}") for i in used])
    rows = rows.unpivot([], rows.columns, "pos", "k").select("pos", "k.h1", "k.h2", "k.x").where("h1 IS NOT NULL")
    hits = rows.join(_listed(df, keys, "pos string, h1 long, h2 long"), ["pos", "h1", "h2"])
    return {(r["pos"], r["h1"], r["h2"]): r["x"] for r in hits.groupBy("pos", "h1", "h2").agg(F.min("x").alias("x")).collect()}


def _smallest_tied(df: DataFrame, x: Column, head: str, cnt: int | None, want: int, most: int) -> list[str]:
    """The `want` smallest of the long texts that begin with `head` and stand in `cnt` rows (any number, if none is given).

    Their digests are counted first. Up to `most` of them are looked up in one scan; where more are tied, those in one
    row need no grouping at all, and the others send one text per map task.
    """
    head_key, h1, h2 = cells.text_digest(x)
    rows = df.select(x.alias("x"), head_key, h1, h2).where((F.col("head") == F.lit(head)) & F.col("h1").isNotNull())
    counted, asked = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("cnt")), F.lit(True) if cnt is None else F.col("cnt") == cnt
    tied = [(r["h1"], r["h2"]) for r in counted.where(asked).select("h1", "h2").limit(most + 1).collect()]
    if len(tied) <= most:
        rows = rows.join(_listed(df, tied, "h1 long, h2 long"), ["h1", "h2"])
    elif cnt == 1:
        repeated = [(r["h1"], r["h2"]) for r in counted.where("cnt > 1").select("h1", "h2").limit(most + 1).collect()]
        if len(repeated) <= most:
            once = rows.join(_listed(df, repeated, "h1 long, h2 long"), ["h1", "h2"], "left_anti")
            return [r["x"] for r in once.select("x").orderBy("x").limit(want).collect()]
    whole = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("cnt"), F.min("x").alias("x")).where(asked)
    return [r["x"] for r in whole.select("x").orderBy("x").limit(want).collect()]


LOOKED_UP = 10_000  # digests sent to a scan that fetches their texts


def top_cells(df: DataFrame, exprs: dict[str, Column], k: int, most: int = LOOKED_UP) -> dict[str, list[tuple[str | None, int]]]:
    """Per column the k most frequent cells (text, rows), ties by smallest text, null last; k rows per column reach the driver.

    The counts are shuffled by fixed-width keys. Cells are ranked by count and head; only texts that are shown, or tied with the
    last one shown in both, are read whole.
    """
    order = [F.desc("cnt"), F.col("head").asc_nulls_last(), F.col("h1").asc_nulls_first(), "h2"]
    # The k best per (column, hash slice) first, so that no task ranks a whole high-cardinality column.
    sliced = cell_counts(df, exprs).withColumn("slice", F.pmod(F.xxhash64("head", "h1"), F.lit(256)))
    local = sliced.withColumn("r", F.row_number().over(Window.partitionBy("pos", "slice").orderBy(*order))).where(F.col("r") <= k)
    best = local.withColumn("r", F.row_number().over(Window.partitionBy("pos").orderBy(*order))).where(F.col("r") <= k)
    by_pos: dict[str, list] = {}
    for r in sorted(best.select("pos", "head", "h1", "h2", "cnt", "r").collect(), key=lambda r: r["r"]):
        by_pos.setdefault(r["pos"], []).append(r)
    def border(rows: list) -> tuple | None:
        """(head, count) shared by the last cell shown and perhaps by others; no others if it is short or all cells are shown."""
        return (rows[-1]["head"], rows[-1]["cnt"]) if rows[-1]["h1"] is not None and len(rows) == k else None
    inner = {p: [r for r in rows if r["h1"] is not None and (r["head"], r["cnt"]) != border(rows)] for p, rows in by_pos.items()}
    texts = texts_of(df, exprs, [(p, r["h1"], r["h2"]) for p, rows in inner.items() for r in rows])
    out: dict[str, list[tuple[str | None, int]]] = {}
    for pos, rows in by_pos.items():
        shown = [(r["head"] if r["h1"] is None else texts[(pos, r["h1"], r["h2"])], r["cnt"]) for r in rows if r["h1"] is None or (r["head"], r["cnt"]) != border(rows)]
        if border(rows):
            head, cnt = border(rows)
            shown += [(x, cnt) for x in _smallest_tied(df, list(exprs.values())[int(pos[1:])], head, cnt, k - len(shown), most)]
        shown.sort(key=lambda v: (-v[1], v[0] is None, (v[0] or "").encode()))
        out[list(exprs)[int(pos[1:])]] = shown
    return out


def smallest_texts(df: DataFrame, x: Column, k: int, most: int = LOOKED_UP) -> list[str]:
    """The k smallest distinct texts; whole texts are read only where they share the head of the last one shown."""
    keys = df.select(*cells.text_digest(x)).where("head IS NOT NULL").groupBy("head", "h1", "h2").agg(F.lit(1).alias("one"))
    rows = keys.orderBy("head", F.col("h1").asc_nulls_first(), "h2").limit(k).collect()
    last = rows[-1]["head"] if rows and rows[-1]["h1"] is not None else None
    inner = texts_of(df, {"x": x}, [("c0", r["h1"], r["h2"]) for r in rows if r["h1"] is not None and r["head"] != last])
    shown = [r["head"] if r["h1"] is None else inner["c0", r["h1"], r["h2"]] for r in rows if r["h1"] is None or r["head"] != last]
    shown += _smallest_tied(df, x, last, None, k - len(shown), most) if last is not None else []
    return sorted(shown, key=lambda v: v.encode())


def heavy_hitters(
    df: DataFrame, columns: list[ColumnInfo], n_rows: int, rare_percent: float = 1.0, tracked: int = 10_000
) -> dict[str, dict[str, Any]]:
    """Distinct count, dominant cell and rare values of text columns without a shuffle of cells.

    One scan merges a distinct sketch and a frequent-items sketch of the cells' digests per column; a second one counts
    the candidates exactly. The items sketch returns every value that fills more than 7 in 16,384 of the rows at `tracked`
    = 10,000, so a dominant cell above that share and the number of values that are not rare are exact; the distinct
    count carries the sketch's error of about one percent. Without such a cell, `dominant_count` is that of the most
    frequent candidate or the gaps, whichever is larger, and 1 where there is neither.
    """
    if rare_percent < 0.5:
        raise ValueError("rare values below half a percent need exact counts")
    exprs = {c.name: cells.text_key(c.name, c.dtype) for c in columns}
    hashes = {n: F.xxhash64(F.lit(17), x) for n, x in exprs.items()}
    digests = {n: F.when(exprs[n].isNotNull(), h) for n, h in hashes.items()}
    found = reduce_cells(df, digests, {
        "n_distinct": "approx_count_distinct(x, 0.01)", "gaps": "count_if(x IS NULL)",
        "items": f"transform(approx_top_k(x, {tracked // 10}, {tracked}), i -> i.item)",
    })
    names = list(exprs)
    found = {n: found.get(n, {"n_distinct": 0, "gaps": 0, "items": []}) for n in names}  # an empty table has no rows here
    wanted = [(f"c{i}", h) for i, n in enumerate(names) for h in found[n]["items"] or [] if h is not None]
    counted: dict[str, list] = {}
    if wanted:
        long = df.select(*[digests[n].alias(f"c{i}") for i, n in enumerate(names)])
        hits = long.unpivot([], long.columns, "pos", "h").join(_listed(df, wanted, "pos string, h long"), ["pos", "h"])
        for r in hits.groupBy("pos", "h").agg(F.count(F.lit(1)).alias("cnt")).collect():
            counted.setdefault(names[int(r["pos"][1:])], []).append((r["cnt"], r["h"]))
    for name, entry in found.items():
        entry.pop("items")
        gaps, held = entry.pop("gaps"), counted.get(name, [])
        common = sum(round(100.0 * cnt / n_rows, 2) >= rare_percent for cnt, _ in held)
        entry["n_distinct"] = max(entry["n_distinct"], len(held))
        entry["n_rare"] = entry["n_distinct"] - common
        top = max((cnt for cnt, _ in held), default=0)
        entry["dominant_count"], entry["dominant_value"] = max(top, gaps, 1 if n_rows else 0), None
        if top >= gaps and top:
            tied = [h for cnt, h in held if cnt == top]
            x = df.where(hashes[name].isin(tied)).select(F.min(exprs[name]).alias("x"))
            entry["dominant_value"] = x.first()["x"]
    return found


def _text_facts(want: set[str]) -> tuple[dict[str, Column], dict[str, str]]:
    """What the wanted statistics read off a text `x`, and their aggregates over (x, cnt) rows; the results are those of `_text_aggs`."""
    facts, aggs = {}, {"n_rows": "sum(cnt)", "n_present": "sum(if(x IS NOT NULL, cnt, 0))"}
    if "numeric" in want:
        facts |= {"is_true": F.expr("x = 'true'"), "is_false": F.expr("x = 'false'")}
        aggs |= {"n_true": "sum(if(is_true, cnt, 0))", "n_false": "sum(if(is_false, cnt, 0))"}
    if "labels" in want:
        labels = ", ".join(f"'{w}'" for w in BOOL_LABELS)
        facts["label"] = F.expr(f"shiftleft(1, CAST(array_position(array({labels}), lower(trim(x))) AS INT))")
        aggs["label_mask"] = "bit_or(label)"
    if "dates" in want:
        facts |= {"nonblank": F.expr("trim(x) <> ''"), "ts": dates.parse_date(F.col("x"))}
        aggs |= {"n_nonblank": "sum(if(nonblank, cnt, 0))", "n_parsed": "sum(if(ts IS NOT NULL, cnt, 0))"}
        aggs |= {"ts_min": "CAST(min(ts) AS STRING)", "ts_max": "CAST(max(ts) AS STRING)"}
    if "classes" in want:
        facts["kind"] = text_class(F.col("x"))
        aggs |= {f"n_{k}": f"sum(if(kind = '{k}', cnt, 0))" for k in TEXT_CLASSES}
    return facts, aggs


def _text_summary(
    df: DataFrame, exprs: dict[str, Column], n_rows: int, rare_percent: float, want: dict[str, set[str]]
) -> dict[str, dict[str, Any]]:
    """`frequency_summary` of texts, which are counted by digest.

    Column by column, so that one with many values does not keep the others from being combined in the map tasks. What a scan
    would read off every cell is read off the distinct ones; of a longer text, whose digest does not tell, before it is counted.
    """
    names, share = list(exprs), cells.percent(F.col("cnt"), F.lit(n_rows))
    found: dict[str, dict[str, Any]] = {}
    kinds: dict[tuple[str, ...], list[int]] = {}
    for i, n in enumerate(names):
        kinds.setdefault(tuple(sorted(want.get(n, ()))), []).append(i)
    for asked, places in kinds.items():
        facts, aggs = _text_facts(set(asked)) if asked else ({}, {})
        far = [F.when(F.col("h1").isNotNull(), F.struct(*[v.alias(k) for k, v in facts.items()])).alias("far")] if facts else []
        for start in range(0, len(places), CHUNK):
            rows = None
            for i in places[start : start + CHUNK]:
                keyed = df.select(exprs[names[i]].alias("x")).select("x", *cells.text_digest(F.col("x")))
                counts = keyed.select("head", "h1", "h2", *far).groupBy("head", "h1", "h2", *["far"] * len(far)).agg(F.count(F.lit(1)).alias("cnt"))
                counts = counts.withColumn("x", F.col("head")).withColumns(
                    {k: F.when(F.col("h1").isNull(), v).otherwise(F.col(f"far.{k}")) for k, v in facts.items()})
                one = counts.agg(
                    F.count("head").alias("n_distinct"), F.count_if(F.col("head").isNotNull() & (share < rare_percent)).alias("n_rare"),
                    F.min(F.struct((-F.col("cnt")).alias("n"), F.col("head").isNull().alias("gap"), "head", F.col("h1").isNotNull().alias("long"))).alias("top"),
                    *[F.expr(a).alias(k) for k, a in aggs.items()],
                ).select(F.lit(i).alias("place"), "*")
                rows = one if rows is None else rows.unionByName(one)
            for r in rows.where("top IS NOT NULL").collect():  # an empty table has no cells
                entry = r.asDict()
                name, top = names[entry.pop("place")], entry.pop("top")
                value = _smallest_tied(df, exprs[name], top["head"], -top["n"], 1, LOOKED_UP)[0] if top["long"] else top["head"]
                found[name] = entry | {"dominant_count": -top["n"], "dominant_value": value}
    return found


def frequency_summary(
    df: DataFrame, columns: list[ColumnInfo], n_rows: int, rare_percent: float = 1.0, want: set[str] = frozenset()
) -> dict[str, dict[str, Any]]:
    """Per column: distinct non-null values, dominant cell (null counts) and rare values.

    Cells are grouped column by column, each scan reading its own column, and one job brings the results of up to CHUNK columns
    together. With `want`, text and boolean columns have what `scan` would give for them as well, except on an empty table.
    """
    found: dict[str, dict[str, Any]] = {}
    share = cells.percent(F.col("cnt"), F.lit(n_rows))
    filled = F.col("value").isNotNull()
    times = {c.name for c in columns if c.group == "datetime"}
    families = _families(columns)
    if "text" in families:
        scanned = {c.name: set(want) for c in columns if want and c.group in ("categorical", "boolean")}
        found |= _text_summary(df, families.pop("text"), n_rows, rare_percent, scanned)
    for exprs in families.values():
        names = list(exprs)
        for start in range(0, len(names), CHUNK):
            rows = None
            for i, n in enumerate(names[start : start + CHUNK], start):
                # Grouped by the bare number, column by column: no column name is hashed and no row carries one.
                counts = df.select(exprs[n].alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("cnt"))
                one = counts.agg(
                    F.count("value").alias("n_distinct"),
                    F.min(F.struct((-F.col("cnt")).alias("n"), F.col("value").isNull().alias("gap"), "value")).alias("top"),
                    F.count_if(filled & (share < rare_percent)).alias("n_rare"),
                ).select(F.lit(i).alias("pos"), "n_distinct", "n_rare", (-F.col("top.n")).alias("dominant_count"),
                         F.col("top.value").cast("string").alias("dominant_value"))
                rows = one if rows is None else rows.unionByName(one)
            for r in rows.where("dominant_count IS NOT NULL").collect():  # an empty table has no cells
                entry = r.asDict()
                name = names[entry.pop("pos")]
                if name in times and entry["dominant_value"] is not None:
                    moment = datetime.fromtimestamp(int(entry["dominant_value"]) / 1e6, timezone.utc)
                    entry["dominant_value"] = moment.strftime("%Y-%m-%d %H:%M:%S")
                found[name] = entry
    return found


def approximate_distinct(df: DataFrame, columns: list[ColumnInfo], medians: dict[str, float | None]) -> dict[str, dict[str, Any]]:
    """Distinct counts of numeric columns from sketches, and the exact count of the only value that can dominate.

    A cell value that fills more than half of the values is their median or an
    infinity, so the near-constant check needs no shuffle of the values.
    """
    exprs = {c.name: cells.present(c.name, c.dtype).cast("double") for c in columns}
    found = reduce_cells(df, exprs, {
        "n_distinct": "approx_count_distinct(x)", "gaps": "count_if(x IS NULL)",
        "plus": "count_if(x = double('infinity'))", "minus": "count_if(x = double('-infinity'))",
    })
    hits = {n: e == F.lit(medians[n]) for n, e in exprs.items() if medians.get(n) is not None}
    counts = reduce_cells(df, hits, {"k": "count_if(x)"}) if hits else {}
    for name, entry in found.items():
        # most rows first, values before the gap, smaller values first
        held = [(-entry.pop("plus"), False, float("inf"), "Infinity"), (-entry.pop("minus"), False, -float("inf"), "-Infinity"), (-entry.pop("gaps"), True, 0.0, None)]
        if name in counts:
            held.append((-counts[name]["k"], False, medians[name], str(medians[name])))
        most = min(h for h in held if h[0] < 0 or h[1])
        entry |= {"dominant_count": -most[0], "dominant_value": most[3]}
    return found


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """One row (rows, duplicate_rows): the extra copies of identical rows.

    Rows are grouped by a 128-bit digest, so the shuffle moves 16 bytes per
    distinct row of a map task and a row copied many times is combined early.
    """
    digest = cells.row_digest([(f.name, f.dataType) for f in df.schema.fields])
    return (
        df.select(digest[0].alias("h1"), digest[1].alias("h2"))
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .agg(
            F.coalesce(F.sum("cnt"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).alias("duplicate_rows"),
        )
    )


def duplicate_column_pairs(df: DataFrame) -> list[tuple[str, str]]:
    """(first, later) pairs of equal columns: equal fingerprint, then null-safe equality of every row."""
    infos = {c.name: c for c in columns_of(df)}
    hashes = fingerprints(df, list(infos.values()))
    first: dict[tuple[str, int], str] = {}
    candidates: list[tuple[str, str]] = []
    for name, c in infos.items():
        key = (c.dtype.simpleString(), hashes[name])
        if key in first:
            candidates.append((first[key], name))
        else:
            first[key] = name
    if not candidates:
        return []
    def cell(n: str) -> Column:
        return cells.text(n, infos[n].dtype) if infos[n].group == "unsupported" else cells.present(n, infos[n].dtype)
    checks = [F.bool_and(cell(a).eqNullSafe(cell(b))).alias(f"e{i}") for i, (a, b) in enumerate(candidates)]
    row = df.agg(*checks).first()
    return [pair for i, pair in enumerate(candidates) if row[f"e{i}"]]
