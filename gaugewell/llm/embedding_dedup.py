"""Near-duplicate vectors by cross-polytope hashing with multiprobe, every candidate verified.

Vectors are padded to a power of two and rotated by three rounds of random signs and fast Hadamard transforms; a hash is the signed
axis nearest to the result. A table combines several hashes. A vector is put into its own bucket of each table and into the buckets
in which the least certain hash is replaced by its second choice. The number of hashes follows the number of vectors, the number of
tables is found by simulating pairs at the threshold, so that the share of such pairs that meet nowhere is at most `miss`.

Equal vectors are one class from the start. Buckets are cut into blocks, and pairs of blocks are compared as matrices in double
precision. A pair of vectors counts only in the smallest bucket that both are in, so counts need no list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.hashing import mix
from gaugewell.llm.shared import components, cut, stored

BLOCK, PROBES, MOST_TABLES = 512, 2, 64


def _signs(seed: int, size: int) -> np.ndarray:
    return np.where(mix(np.arange(size, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(63), 1.0, -1.0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def buckets(x: np.ndarray, tables: int, hashes: int, probes: int = PROBES) -> np.ndarray:
    """Bucket numbers (64-bit hashes) of unit vectors: for each table its own and `probes` others."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    out = []
    for t in range(tables):
        best, second, gap = [], [], []
        for k in range(hashes):
            y = x
            for r in range(3):
                y = hadamard(y * _signs((t * hashes + k) * 3 + r + 1, size))
            top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            value = np.abs(np.take_along_axis(y, top, 1))
            top = np.where(value[:, :1] >= value[:, 1:], top, top[:, ::-1])
            sign = np.take_along_axis(y, top, 1) < 0
            code = (2 * top + sign).astype(np.uint64)
            best.append(code[:, 0])
            second.append(code[:, 1])
            gap.append(np.abs(value[:, 0] - value[:, 1]))
        order = np.argsort(np.array(gap), axis=0, kind="stable")
        for p in range(min(probes, hashes) + 1):
            key = np.full(len(x), np.uint64(t + 1))
            for k in range(hashes):
                choice = np.where(order[p - 1] == k, second[k], best[k]) if p else best[k]
                key = mix(key * np.uint64(2 * size + 1) + choice)
            out.append(key)
    return np.array(out).T.view(np.int64).reshape(len(x), -1)


def plan(count: int, size: int, cosine: float, miss: float) -> tuple[int, int]:
    """(tables, hashes): hashes so that buckets hold few vectors of a random set, tables by simulation of pairs at the threshold."""
    padded = 1 << max(1, (size - 1).bit_length())
    hashes = max(1, round(np.log(max(count, 2)) / np.log(2 * padded)))
    rng = np.random.default_rng(7)
    a = rng.normal(size=(2000, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(2000, size))
    b -= (a * b).sum(1, keepdims=True) * a
    norm = np.linalg.norm(b, axis=1, keepdims=True)
    b = cosine * a + np.sqrt(1 - cosine**2) * b / np.where(norm > 0, norm, 1)
    per = min(PROBES, hashes) + 1
    one, two = buckets(a, 8, hashes), buckets(b, 8, hashes)
    apart = np.mean([~(one[:, None, i * per:(i + 1) * per] == two[:, i * per:(i + 1) * per, None]).any((1, 2)) for i in range(8)])
    return int(min(MOST_TABLES, max(4, np.ceil(np.log(miss) / np.log(min(max(apart, 1e-6), 0.95)))))), hashes


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, bytes of the vector, its length); null where it cannot link."""
    for batch in batches:
        vectors, sizes = [], []
        for v in batch.column(1):
            x = None if not v.is_valid or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
            good = x is not None and len(x) and np.isfinite(x).all() and x.any()
            single = good and (x.astype(np.float32) == x).all()  # single precision holds it without loss
            vectors.append((b"s" + x.astype(np.float32).tobytes() if single else b"d" + x.tobytes()) if good else None)
            sizes.append(len(x) if good else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary()), pa.array(sizes, pa.int32())], names=["id", "v", "size"])


def _unit(packed) -> np.ndarray:
    x = np.array([np.frombuffer(v, np.float32 if v[:1] == b"s" else np.float64, offset=1) for v in packed], np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hashed(batches: Iterator[pa.RecordBatch], tables: int, hashes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, len(batch), 2048):
            part = batch.slice(first, 2048)
            found = buckets(_unit(part.column(2).to_pylist()), tables, hashes)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(found), pa.list_(pa.int64()))], names=["id", "buckets"])


SHORT = 16  # runs of up to so many vectors are compared pair by pair, longer ones as matrices


def _links(x: np.ndarray, a: np.ndarray, b: np.ndarray, bucket: np.ndarray, cosine: float, seek: tuple[int, int]) -> np.ndarray:
    """Which candidate pairs link and are in no smaller bucket together."""
    near = np.zeros(len(a), bool)
    for first in range(0, len(a), 65_536):
        part = slice(first, first + 65_536)
        near[part] = (x[a[part]] * x[b[part]]).sum(1) >= cosine
    at = np.flatnonzero(near)
    if len(at):
        used, place = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        lists = np.concatenate([buckets(x[used[i:i + 2048]], *seek) for i in range(0, len(used), 2048)])
        for first in range(0, len(at), 8192):
            part = at[first:first + 8192]
            p, q = lists[place[first:first + len(part)]], lists[place[len(at) + first:len(at) + first + len(part)]]
            same = (p[:, :, None] == q[:, None, :]).any(2)
            near[part] = np.where(same, p, np.iinfo(np.int64).max).min(1) >= bucket[part]
    return near


def _spanning(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, id) that connect what the pairs (a, b) connect: labels fall to the smallest neighbour's, each fall is a link."""
    one, two, label = np.concatenate([a, b]), np.concatenate([b, a]), ids.copy()
    order = np.argsort(one, kind="stable")
    one, two = one[order], two[order]
    begins = np.flatnonzero(np.append(True, one[1:] != one[:-1])) if len(one) else np.zeros(0, np.int64)
    left, right = [], []
    while len(one):
        least = np.minimum.reduceat(label[two], begins)
        fall = least < label[one[begins]]
        if not fall.any():
            break
        size = np.diff(np.append(begins, len(one)))
        through = np.where(label[two] == np.repeat(least, size), np.arange(len(two)), len(two))
        through = two[np.minimum.reduceat(through, begins)]
        left.append(ids[one[begins[fall]]])
        right.append(ids[through[fall]])
        label[one[begins[fall]]] = least[fall]
    return np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])


def _compare(batches: Iterator[pa.RecordBatch], cosine: float, tables: int, hashes: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by pair of blocks: how many vectors each links with there, and links that connect what is connected."""
    held: pa.Table | None = None

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = [table.column(c).to_numpy() for c in ("bucket", "low", "high")]
        salt, ids, copies = (table.column(c).to_numpy() for c in ("salt", "id", "copies"))
        x = _unit(table.column("v").to_pylist())
        new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
        begins = np.append(np.flatnonzero(new), len(ids))
        run = np.cumsum(new) - 1
        length = np.diff(begins)[run]
        a, b = [], []
        plain = (keys[1] == keys[2]) & (length <= SHORT)
        for step in range(1, SHORT):
            at = np.flatnonzero(plain[:-step] & (run[:-step] == run[step:])) if step < len(run) else np.zeros(0, np.int64)
            a.append(at)
            b.append(at + step)
        for first, last in zip(begins[:-1], begins[1:]):
            if plain[first] or last - first < 2:
                continue
            here = np.arange(first, last)
            one, two = here[salt[here] == keys[1][first]], here[salt[here] == keys[2][first]]
            p, q = np.nonzero(x[one] @ x[two].T >= cosine - 1e-9)
            keep = p < q if keys[1][first] == keys[2][first] else np.ones(len(p), bool)
            a.append(one[p[keep]])
            b.append(two[q[keep]])
        a, b = np.concatenate(a), np.concatenate(b)
        good = _links(x, a, b, keys[0][a], cosine, (tables, hashes))
        a, b = a[good], b[good]
        links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        counted = np.flatnonzero(links)
        left, right = _spanning(ids, a, b)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids[counted], left])), pa.array(np.concatenate([links[counted].astype(np.int64), np.zeros(len(left), np.int64)])),
             pa.array(np.concatenate([ids[counted], right]))], names=["id", "links", "other"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]) if held is not None else table
        if held.num_rows < 2:
            continue
        keys = [held.column(c).to_numpy() for c in ("bucket", "low", "high")]
        last = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
        if len(last):
            yield from whole(held.slice(0, int(last[-1]) + 1).combine_chunks())
            held = held.slice(int(last[-1]) + 1)
    if held is not None and held.num_rows:
        yield from whole(held.combine_chunks())


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, miss: float = 1e-4) -> DataFrame:
    """One row per input row: id, n_links (other vectors linked directly), component_id (smallest id reachable), kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Rows that repeat an id are vectors of
    their own; a null id is never the smallest, and a row in a component of null ids only is kept. Vectors of different lengths link
    only within a length. Other columns are ignored. An empty table gives an empty result.
    """
    rows = stored(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
                  .mapInArrow(_classes, "id long, v binary, size int").withColumn("d", F.sha2("v", 256)))
    classes = rows.where("v is not null").groupBy("d").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"), F.max("size").alias("size"))
    classes = stored(classes.withColumn("id", F.xxhash64("d")))
    lengths = [(r["size"], r["count"]) for r in classes.groupBy("size").count().collect()]  # one row per vector length
    found = None
    for size, count in lengths:
        tables, hashes = plan(count, size, cosine, miss)
        held = classes.where(F.col("size") == size).select("id", "copies", "v")
        places = stored(held.mapInArrow(partial(_hashed, tables=tables, hashes=hashes), "id long, buckets array<long>")
                        .select("id", F.explode(F.array_distinct("buckets")).alias("bucket")))
        parts = places.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / BLOCK).alias("parts"))
        dealt = places.join(parts, "bucket").withColumn("salt", F.pmod(F.xxhash64("id", "bucket"), "parts"))
        dealt = dealt.withColumn("mate", F.explode(F.expr("sequence(0L, parts - 1)"))).join(held, "id")
        dealt = dealt.withColumn("low", F.least("salt", "mate")).withColumn("high", F.greatest("salt", "mate")).select("bucket", "low", "high", "salt", "id", "copies", "v")
        dealt = dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "id")
        links = dealt.mapInArrow(partial(_compare, cosine=cosine, tables=tables, hashes=hashes), "id long, links long, other long")
        found = links if found is None else found.union(links)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "id")
    roots = cut(classes.select("id", "d", "least", "copies").join(counts, "id", "left").join(joined, "id", "left").withColumn("root", F.coalesce("component", "id")))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    roots = roots.join(least, "root").select("d", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(roots, "d", "left")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), component.isNull()).alias("kept"))

