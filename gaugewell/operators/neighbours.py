"""Nearest-neighbour estimate of the mutual information between numeric features and a class.

For a row with value v, let r be the distance to its k-th nearest row of the same class, and let k' and m be the rows of its class and
of all classes in the open interval (v - r, v + r), itself included (at r = 0: the rows equal to v). The estimate is
digamma(n) + mean(digamma(k')) - mean(digamma(rows of the class)) - mean(digamma(m)), in nats, never below zero. Where no two distances
are equal, k' = k and this is the usual estimator; equal values need no noise to be told apart. Classes of one row are left out.

Rows are counted by (feature, class, value) first, so repeated values cost one row. Each feature's range is cut into cells that hold about
as many rows; neighbours are read with window functions inside a cell, and the first and last k values of the cells of a class,
a few thousand rows, are ordered once more to supply the neighbours beyond a cell's border. Intervals are counted by a running
sum inside each cell plus the rows of the cells before it. No class and no feature is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugewell.functions import cells
from gaugewell.functions.small import small_table
from gaugewell.operators import stats
from gaugewell.operators.schema import columns_of

ROWS_PER_CELL = 1_000_000
_SCHEMA = {"column": "string", "mutual_information": "double", "rows_used": "long", "target_kind": "string"}


def digamma(n: Column) -> Column:
    """Digamma of a whole number from 1 on, by recurrence to n + 6 and the asymptotic series (error below 1e-10)."""
    x = n.cast("double") + 6.0
    steps = sum((1.0 / (n.cast("double") + float(i)) for i in range(1, 6)), 1.0 / n.cast("double"))
    y = 1.0 / (x * x)
    return F.ln(x) - 0.5 / x - y / 12.0 + y * y / 120.0 - y * y * y / 252.0 + y * y * y * y / 240.0 - steps


def _cell(x: str, cuts: list[list[float]], parts: int) -> Column:
    """The cell of x among the cut points of the row's feature (`pos`): between two of them, and there one of `parts` stretches of equal width.

    The number of cut points below x is found by bisection. The cell never falls as x rises.
    """
    lists = ", ".join("array(" + ", ".join(f"{c!r}D" for c in some) + ")" for some in cuts)
    own = f"element_at(array({lists}), CAST(substring(pos, 2) AS INT) + 1)"
    steps = ", ".join(str(1 << i) for i in reversed(range(max(map(len, cuts)).bit_length())))
    coarse = f"aggregate(array({steps}), 0, (i, s) -> IF(get({own}, i + s - 1) < {x}, i + s, i))"
    if parts == 1:
        return F.expr(coarse).cast("long")
    within = F.expr(f"least({parts - 1}, greatest(0, floor(({x} - get({own}, coarse - 1)) / (get({own}, coarse) - get({own}, coarse - 1)) * {parts})))".replace("coarse", f"({coarse})"))
    return F.expr(coarse).cast("long") * parts + F.coalesce(within, F.lit(0))


def _with_neighbours(rows: DataFrame, k: int) -> DataFrame:
    """Adds `near`: (value, rows) of the k distinct values of the class on each side, across cell borders."""
    inside, reverse = (Window.partitionBy("pos", "y", "cell").orderBy(o) for o in (F.col("v"), F.desc("v")))
    across = Window.partitionBy("pos", "y").orderBy("v")
    at = F.struct("v", "cnt")
    sides = [(f"{side}{j}", step(at, j)) for j in range(1, k + 1) for side, step in (("a", F.lag), ("b", F.lead))]
    rows = rows.withColumns({"from_start": F.row_number().over(inside), "from_end": F.row_number().over(reverse)})
    rows = rows.withColumns({name: step.over(inside) for name, step in sides})
    edges = rows.where((F.col("from_start") <= k) | (F.col("from_end") <= k)).select("pos", "y", "cell", "v", "cnt")
    edges = edges.select("pos", "y", "cell", "v", *[step.over(across).alias(f"e{name}") for name, step in sides])
    both = rows.join(edges, ["pos", "y", "cell", "v"], "left")
    near = F.array_compact(F.array(*[F.coalesce(name, f"e{name}") for name, _ in sides]))
    return both.select("pos", "y", "cell", "v", "cnt", near.alias("near"))


def neighbour_information(df: DataFrame, target: str, k: int = 3, rows_per_cell: int | None = None) -> DataFrame:
    """(column, mutual_information, rows_used, target_kind) of every numeric feature with the classes of `target`, over all labelled rows.

    Gaps and infinities become the feature's exact median; constant features are left out. Every distinct value of the target is a class.
    """
    t = columns_of(df, [target])[0]
    spark, label = df.sparkSession, cells.text_key(target, t.dtype)
    labelled = df.where(cells.present(target, t.dtype).isNotNull())
    infos = {c.name: c for c in columns_of(df) if c.group == "numeric" and c.name != target}
    medians, _, grids = stats.filled_quantiles(labelled, list(infos), []) if infos else ({}, {}, {})
    names = [n for n in infos if n in medians]
    classes = labelled.groupBy(label.alias("y")).agg(F.count(F.lit(1)).alias("n_y")).where("n_y > 1")
    n = classes.agg(F.sum("n_y")).first()[0]
    if not names or not n:
        return small_table(spark, [], _SCHEMA)
    parts = max(1, -(-n // ((len(stats.GRID) + 1) * (rows_per_cell or ROWS_PER_CELL))))
    cuts = [sorted(set(grids[c])) for c in names]
    wide = labelled.select(label.alias("y"), *[F.coalesce(cells.finite(c, infos[c].dtype), F.lit(medians[c])).alias(f"c{i}") for i, c in enumerate(names)])
    counted = wide.unpivot(["y"], [f"c{i}" for i in range(len(names))], "pos", "v").groupBy("pos", "y", "v").agg(F.count(F.lit(1)).alias("cnt"))
    counted = counted.join(classes, "y").withColumn("cell", _cell("v", cuts, parts))

    # distance to the k-th neighbour: others at the same value come first, then the nearest values on both sides
    rows = _with_neighbours(counted.drop("n_y"), k)
    steps = F.array_sort(F.transform("near", lambda u: F.struct(F.abs(u["v"] - F.col("v")).alias("d"), u["cnt"].alias("cnt"))))
    start = F.struct((F.col("cnt") - 1).alias("seen"), F.lit(0.0).alias("r"))
    # stops growing once k others are seen; a class of fewer gives its farthest
    reached = F.aggregate(steps, start, lambda s, u: F.when(s["seen"] < k, F.struct((s["seen"] + u["cnt"]).alias("seen"), u["d"].alias("r"))).otherwise(s))
    rows = rows.withColumn("r", reached["r"]).withColumns({"lo": F.col("v") - F.col("r"), "hi": F.col("v") + F.col("r")})
    own = F.aggregate("near", F.col("cnt"), lambda s, u: s + F.when((u["v"] > F.col("lo")) & (u["v"] < F.col("hi")), u["cnt"]).otherwise(0))
    rows = rows.select("pos", "y", "v", "cnt", "lo", "hi", F.when(F.col("r") > 0, own).otherwise(F.col("cnt")).alias("k_own"))

    # rows of all classes inside each interval: running counts at both ends, in the order of the values
    points = counted.groupBy("pos", "cell", "v").agg(F.sum("cnt").alias("w")).select("pos", "cell", F.col("v").alias("x"), F.lit(1).alias("turn"), "w", F.lit(None).cast("string").alias("y"), F.lit(None).cast("double").alias("v"))
    # at r = 0 the closed interval counts: the lower end is asked before the points that equal it, the upper one after
    same = F.col("lo") == F.col("hi")
    ends = F.array(F.struct(F.col("lo").alias("x"), F.when(same, 0).otherwise(2).alias("turn")), F.struct(F.col("hi").alias("x"), F.when(same, 2).otherwise(0).alias("turn")))
    asked = rows.select("pos", "y", "v", F.posexplode(ends).alias("side", "end")).select("pos", "y", "v", "side", "end.x", "end.turn")
    asked = asked.withColumn("cell", _cell("x", cuts, parts))
    events = points.withColumn("side", F.lit(None).cast("int")).unionByName(asked.withColumn("w", F.lit(0).cast("long")))
    sums = Window.partitionBy("pos", "cell").orderBy("x", "turn").rowsBetween(Window.unboundedPreceding, 0)
    totals = counted.groupBy("pos", "cell").agg(F.sum("cnt").alias("w"))
    # as many rows as cells: ordered by feature
    before = totals.select("pos", "cell", (F.sum("w").over(Window.partitionBy("pos").orderBy("cell")) - F.col("w")).alias("rows_before"), F.lit(True).alias("known"))
    upto = events.withColumn("upto", F.sum("w").over(sums)).where("side IS NOT NULL")
    inner = upto.join(before, ["pos", "cell"], "left")
    # an end may fall into a cell without rows: then the cells before it count
    lost = inner.where("known IS NULL")
    filled = totals.select("pos", "cell", "w").join(lost.select("pos", F.col("cell").alias("empty")).distinct(), "pos").where("cell < empty")
    filled = filled.groupBy("pos", F.col("empty").alias("cell")).agg(F.sum("w").alias("below"))
    inner = inner.join(filled, ["pos", "cell"], "left").withColumn("c", F.col("upto") + F.coalesce("rows_before", "below", F.lit(0)))
    m = inner.groupBy("pos", "y", "v").agg(F.sum(F.when(F.col("side") == 1, F.col("c")).otherwise(-F.col("c"))).alias("m"))
    scored = rows.join(m, ["pos", "y", "v"]).join(classes, "y")
    per_column = scored.groupBy("pos").agg(
        F.sum("cnt").alias("n"),
        F.sum(F.col("cnt") * (digamma(F.col("k_own")) - digamma(F.col("n_y")) - digamma(F.col("m")))).alias("s"))
    listed = F.array(*[F.lit(c) for c in names])
    return per_column.select(
        F.element_at(listed, F.substring("pos", 2, 9).cast("int") + 1).alias("column"),
        F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("s") / F.col("n")).alias("mutual_information"), F.col("n").alias("rows_used"),
        F.lit("classification").alias("target_kind"))
