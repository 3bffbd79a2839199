"""Deterministic splits, folds and samples.

Rows are ordered by md5(key:seed) inside their class, and a split is a hash
threshold per class: a row's side follows from its own hash and the threshold.
The thresholds come from a histogram of hash prefixes and from the rows of one
prefix bucket, so no class is ever sorted or held by one task, however large.
Nor are the rows of one key: a bucket with many rows is cut again by row digest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugewell.errors import AuditError
from gaugewell.functions import cells
from gaugewell.functions.small import small_table
from gaugewell.operators.schema import columns_of

ONE_STRATUM = "all"
BROADCAST_ROWS = 100_000  # threshold rows that may be broadcast; checked before use
SORTED_ROWS = 100_000  # rows of one bucket that are sorted together
COLLECTED_ROWS = 10_000  # thresholds that are found once and kept; more stay a table that every pass makes again


def hash_key(df: DataFrame, key: str | list[str] | None, seed: int) -> Column:
    """md5 of the key and the seed, followed by the key, as one sortable string.

    A digest of the whole row and its place in the input follow, so rows that share a key, and copies of a row, take different
    ranks and every quota is met exactly. Among copies of a row it does not matter which one is taken; the place is that of the
    scan, so an input whose row order changes between passes should be written to a table first.
    """
    infos = columns_of(df)
    row = F.concat_ws("/", *[h.cast("string") for h in cells.row_digest([(c.name, c.dtype) for c in infos])])
    if key is None:
        ident = row
    else:
        names = [key] if isinstance(key, str) else key
        ident = F.concat_ws("/", *[cells.text(c.name, c.dtype) for n in names for c in infos if c.name == n])
    place = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    return F.concat(F.md5(F.concat(ident, F.lit(f":{seed}"))), F.lit(":"), ident, F.lit(":"), F.md5(row), F.lit(":"), place)


def _keyed(df: DataFrame, key, seed: int, stratum: str | None) -> DataFrame:
    s = F.lit(ONE_STRATUM)
    if stratum is not None:
        info = columns_of(df, [stratum])[0]
        s = F.coalesce(cells.text_key(stratum, info.dtype), F.lit("\u0000null"))
    return df.withColumns({"__s": s, "__h": hash_key(df, key, seed)})


def _edges(rows: DataFrame, ranks: DataFrame, near: list[str], small: bool) -> DataFrame:
    """(__s, part, __b, rest, cnt): the bucket __b that holds each wanted rank, the rank inside it, and the rows in it."""
    histogram = rows.groupBy("__s", *near, "__b").agg(F.count(F.lit(1)).alias("cnt"))
    running = histogram.withColumn("upto", F.sum("cnt").over(Window.partitionBy("__s", *near).orderBy("__b")))
    wanted = running.join(F.broadcast(ranks) if small else ranks, ["__s", *near])
    return wanted.where("upto >= rank AND upto - cnt < rank").select("__s", "part", "__b", (F.col("rank") - F.col("upto") + F.col("cnt")).alias("rest"), "cnt")


def _thresholds(keyed: DataFrame, ranks: DataFrame, n_rows: int, n_ranks: int) -> DataFrame:
    """(__s, cuts): per stratum the hash at each wanted rank, in rank order.

    `ranks` holds (__s, part, rank). The prefix length makes buckets and bucket
    sizes both about the square root of the row count. Where many rows share a key,
    the bucket of a rank is cut again by the digest of the row and at last by its place,
    so that no more than SORTED_ROWS rows, or 65,536 copies of one row, are sorted together.
    """
    digits = max(1, min(8, math.ceil(math.log(max(n_rows, 2), 16) / 2)))
    small = n_ranks <= BROADCAST_ROWS
    bucket = F.substring("__h", 1, digits)
    edges = _edges(keyed.select("__s", bucket.alias("__b")), ranks, [], small)
    # What a bucket leaves off the end of the hash: most of the row's digest and its place, the place, parts of the place.
    for tail in (49 - digits, 17, 8, 4):
        if n_ranks <= COLLECTED_ROWS:
            edges = small_table(keyed.sparkSession, [r.asDict() for r in edges.collect()], {"__s": "string", "part": "long", "__b": "string", "rest": "long", "cnt": "long"})
        if (edges.agg(F.max("cnt")).first()[0] or 0) <= SORTED_ROWS:
            break
        near = keyed.select("__s", "__h", bucket.alias("__b")).join(F.broadcast(edges) if small else edges, ["__s", "__b"])
        bucket = F.expr(f"substring(__h, 1, length(__h) - {tail})")
        edges = _edges(near.select("__s", "part", bucket.alias("__b")), edges.select("__s", "part", F.col("rest").alias("rank")), ["part"], small)
    near = keyed.select("__s", "__h", bucket.alias("__b")).join(F.broadcast(edges) if small else edges, ["__s", "__b"])
    place = F.row_number().over(Window.partitionBy("__s", "part", "__b").orderBy("__h"))
    cuts = near.withColumn("place", place).where("place = rest")
    return cuts.groupBy("__s").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("part", "__h"))), lambda c: c["__h"]).alias("cuts"))


def _settled(cuts: DataFrame, n_ranks: int) -> DataFrame:
    """Thresholds found once, one row per class, so that later passes over the labelled rows do not search for them again."""
    if n_ranks > COLLECTED_ROWS:
        return cuts
    return small_table(cuts.sparkSession, [r.asDict() for r in cuts.collect()], {"__s": "string", "cuts": "strings"})


def _label(keyed: DataFrame, cuts: DataFrame, n_strata: int) -> DataFrame:
    """Add __part: the number of thresholds below the row's hash."""
    small = n_strata <= BROADCAST_ROWS
    joined = keyed.join(F.broadcast(cuts) if small else cuts, "__s", "left")
    below = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("__h"))), F.lit(0))
    return joined.withColumn("__part", below).drop("cuts")


def class_sizes(df: DataFrame, target: str) -> DataFrame:
    info = columns_of(df, [target])[0]
    return df.groupBy(cells.text_key(target, info.dtype).alias("class")).agg(F.count(F.lit(1)).alias("cnt"))


def stratify_check(df: DataFrame, target: str, test_size: float = 0.2) -> DataFrame:
    """One row: sizes of both sides, class count, smallest class and whether a split by class works."""
    row = class_sizes(df, target).agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("classes"),
        F.coalesce(F.min("cnt"), F.lit(0)).alias("smallest_class"),
    )
    test = F.ceil(F.col("rows") * F.lit(float(test_size)))
    return row.withColumn("test_rows", test).withColumn("train_rows", F.col("rows") - test).withColumn(
        "can_stratify",
        F.expr("classes >= 2 AND smallest_class >= 2 AND test_rows >= classes AND train_rows >= classes"),
    )


def test_quotas(sizes: DataFrame, rows: int, test_rows: int) -> DataFrame:
    """(class, cnt, quota): floor shares plus one for the largest remainders, ties by class; sums to test_rows."""
    exact = sizes.withColumn("product", F.expr(f"CAST(cnt AS DECIMAL(19,0)) * CAST({test_rows} AS DECIMAL(19,0))"))
    parts = exact.select(
        "class", "cnt", F.expr(f"product div {rows}").alias("base"),
        F.expr(f"CAST(product % {rows} AS BIGINT)").alias("left_over"),
    )
    given = parts.agg(F.coalesce(F.sum("base"), F.lit(0)).alias("b")).first()["b"]
    lucky = parts.orderBy(F.desc("left_over"), F.asc_nulls_last("class")).limit(max(0, test_rows - given))
    bonus = lucky.select(F.col("class").alias("lucky_class"), F.lit(1).alias("bonus"))
    joined = parts.join(bonus, F.col("class").eqNullSafe(F.col("lucky_class")), "left")
    return joined.select("class", "cnt", (F.col("base") + F.coalesce("bonus", F.lit(0))).alias("quota"))


def train_test_split(
    df: DataFrame, key: str | list[str] | None, target: str | None = None, test_size: float = 0.2, seed: int = 42,
    stratify: bool | None = None,
) -> DataFrame:
    """Add is_test. With a target the split is by class when that is feasible (or when asked for)."""
    if not 0 < test_size < 1:
        raise AuditError("test_size must lie between 0 and 1.")
    by_class, n_strata = False, 1
    if target is not None and stratify is not False:
        row = stratify_check(df, target, test_size).first()
        by_class, n_rows, n_strata = bool(row["can_stratify"]), row["rows"], row["classes"]
    if not by_class:
        n_rows, n_strata = df.count(), 1
    if n_rows < 2:
        raise AuditError("A split needs at least 2 rows.")
    test_rows = math.ceil(n_rows * test_size)
    keyed = _keyed(df, key, seed, target if by_class else None)
    sizes = keyed.groupBy(F.col("__s").alias("class")).agg(F.count(F.lit(1)).alias("cnt"))
    ranks = test_quotas(sizes, n_rows, test_rows).where("quota > 0").select(
        F.col("class").alias("__s"), F.lit(1).alias("part"), F.col("quota").alias("rank"))
    cuts = _settled(_thresholds(keyed, ranks, n_rows, n_strata), n_strata)
    # A class without test rows has no threshold and stays in training.
    small = n_strata <= BROADCAST_ROWS
    joined = keyed.join(F.broadcast(cuts) if small else cuts, "__s", "left")
    side = F.coalesce(F.col("__h") <= F.element_at("cuts", 1), F.lit(False))
    return joined.withColumn("is_test", side).drop("__s", "__h", "cuts")


def safe_folds(df: DataFrame, target: str | None, requested: int = 5) -> int | None:
    """Folds capped by rows and, by class, by the smallest class; None below two."""
    if requested < 2:
        return None
    if target is None:
        folds = min(requested, df.count())
    else:
        row = class_sizes(df, target).agg(F.count(F.lit(1)).alias("k"), F.min("cnt").alias("m"), F.sum("cnt").alias("n")).first()
        folds = min(requested, row["n"] or 0, row["m"] or 0) if row["k"] >= 2 else 0
    return folds if folds >= 2 else None


def assign_folds(df: DataFrame, key: str | list[str] | None, target: str | None = None, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add fold (0-based). Fold sizes differ by at most one in every class."""
    keyed = _keyed(df, key, seed, target)
    sizes = keyed.groupBy("__s").agg(F.count(F.lit(1)).alias("cnt"))
    row = sizes.agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("k")).first()
    ranks = sizes.select("__s", "cnt", F.explode(F.sequence(F.lit(1), F.lit(folds - 1))).alias("part")).select(
        "__s", "part", F.expr(f"part * (cnt div {folds}) + least(part, cnt % {folds})").alias("rank"))
    n_ranks = row["k"] * (folds - 1)
    cuts = _settled(_thresholds(keyed, ranks, row["n"] or 0, n_ranks), n_ranks)
    labelled = _label(keyed, cuts, row["k"])
    return labelled.withColumn("fold", F.col("__part").cast("long")).drop("__s", "__h", "__part")


def sample_rows(df: DataFrame, n: int, key: str | list[str] | None = None, seed: int = 42) -> DataFrame:
    """The n rows with the smallest key hash; the whole table when it is not larger."""
    rows = df.count()
    if rows <= n:
        return df
    keyed = _keyed(df, key, seed, None)
    ranks = keyed.sparkSession.range(1).select(
        F.lit(ONE_STRATUM).alias("__s"), F.lit(1).alias("part"), F.lit(n).cast("long").alias("rank"))
    cut = _thresholds(keyed, ranks, rows, 1).first()["cuts"][0]
    return keyed.where(F.col("__h") <= cut).drop("__s", "__h")
