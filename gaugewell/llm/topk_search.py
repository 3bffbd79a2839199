"""Exact top-k by inner product: document-range blocks in the order of their summed term maxima, scored until the bounds fall below the kth.

A term is a component. Documents are numbered along the leaves of a tree of bisections, so that neighbours are alike, and cut into blocks of
consecutive documents. A block is one row: its forward index (the packed components of its documents) and, for each term, the largest
and the smallest component. For a query, the sum over the terms of weight times the maximum (times the minimum where the weight is
negative) bounds every score in the block.

1. At home: each query goes through the blocks of its own shard, a run of neighbouring blocks, and comes out with a first kth score.
2. Routing: the bounds of all other blocks, read from their maxima alone, name the shards that may still hold a better document.
3. Cells: a cell is one shard and the queries of a few neighbouring shards; only blocks whose bound reaches the kth are scored.
4. The best k of what home and cells returned.

No step holds more than a shard and a bounded number of queries; a query never meets a block that its bound excludes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.llm.integer_vectors import binary_rows, matrix, packed_vectors, sizes_of, width_of
from gaugewell.llm.shared import stored

BLOCK = 128  # documents of a block
SAMPLE = 4_096  # vectors that fit the tree of bisections; every vector is indexed
LEAVES = 10  # levels of that tree
GROUP = 8  # neighbouring shards whose queries travel together
PAGE = 16  # neighbouring shards whose maxima are read together
SLICE = 1_024  # queries bounded at a time inside a task
LAST = np.iinfo(np.int64).max
NONE = np.iinfo(np.int64).min


def shard_size(count: int, size: int) -> int:
    """Documents of a shard: it grows with the root of the table, so that routed rows and shards grow alike, up to 32 million components."""
    return int(max(1, min(max(2_048, 16 * count ** 0.5), (1 << 25) // max(size, 1))))


# --- numbering

def bisections(x: np.ndarray, levels: int = LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """A complete binary tree over a sample: at each node a direction (the strongest of its vectors) and the median along it."""
    directions, cuts = np.zeros(((1 << levels) - 1, x.shape[1])), np.full((1 << levels) - 1, np.inf)
    members = {0: np.arange(len(x))}
    for node in range(len(cuts)):
        at = members.pop(node, np.zeros(0, np.int64))
        if len(at) < 8:
            continue
        y = x[at] - x[at].mean(0)
        direction = y[np.argmax((y * y).sum(1))]
        for _ in range(8):
            direction = y.T @ (y @ direction)
            length = np.linalg.norm(direction)
            if not length:
                break
            direction = direction / length
        along = x[at] @ direction
        directions[node], cuts[node] = direction, np.median(along)
        members[2 * node + 1], members[2 * node + 2] = at[along < cuts[node]], at[along >= cuts[node]]
    return directions, cuts


def _leaves(batches: Iterator[pa.RecordBatch], size: int, directions: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = matrix(batch.column("v"), batch.column("width").to_numpy(), size).astype(np.float64)
        node = np.zeros(len(x), np.int64)
        while len(node) and node[0] < len(cuts):
            node = 2 * node + 1 + ((x * directions[node]).sum(1) >= cuts[node])
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("r", "id", "query", "width", "v")] + [pa.array(node.astype(np.int32))],
                                         names=["r", "id", "query", "width", "v", "leaf"])


# --- blocks

_BLOCKS = "part int, block int, n int, r array<long>, id array<long>, query array<boolean>, width int, v binary, low binary, high binary, least long"


def _block(rows: pa.Table, size: int, part: int, block: int) -> pa.RecordBatch:
    x = matrix(rows.column("v").combine_chunks(), rows.column("width").to_numpy(), size)
    width, ids = width_of(x), rows.column("id").to_numpy(zero_copy_only=False) if not rows.column("id").null_count else rows.column("id").drop_null().to_numpy()
    one = lambda values: pa.array([values])
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([rows.column("r").to_pylist()], pa.list_(pa.int64())),
         pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([rows.column("query").to_pylist()], pa.list_(pa.bool_())), pa.array([width], pa.int32()),
         one(x.astype(f"<i{width}").tobytes()), binary_rows(x.min(0)[None], width), binary_rows(x.max(0)[None], width),
         pa.array([int(ids.min()) if len(ids) else LAST], pa.int64())],
        names=["part", "block", "n", "r", "id", "query", "width", "v", "low", "high", "least"])


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, block, held = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        while held.num_rows >= BLOCK:
            yield _block(held.slice(0, BLOCK), size, part, block)
            held, block = held.slice(BLOCK), block + 1
    if held is not None and held.num_rows:
        yield _block(held, size, part, block)


class _Shard:
    """Blocks of one shard side by side: documents in rows, block borders in `at`, maxima and minima by block."""

    def __init__(self, table: pa.Table, size: int):
        table = table.sort_by([("part", "ascending"), ("block", "ascending")])
        self.low, self.high, self.least = _ends(table, size)
        counts, widths = table.column("n").to_numpy(), table.column("width").to_numpy()
        self.at = np.append(0, np.cumsum(counts))
        self.x = np.empty((self.at[-1], size), np.int64)
        for i, v in enumerate(table.column("v").to_pylist()):
            self.x[self.at[i]:self.at[i + 1]] = np.frombuffer(v, f"<i{widths[i]}").reshape(counts[i], size)
        ids = table.column("id").combine_chunks().flatten()
        self.known, self.id = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(LAST).to_numpy()
        self.r = table.column("r").combine_chunks().flatten().to_numpy()
        self.query = table.column("query").combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _ends(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    widths = table.column("width").to_numpy()
    return matrix(table.column("low"), widths, size), matrix(table.column("high"), widths, size), table.column("least").to_numpy()


def _exact(*parts: np.ndarray, size: int) -> type:
    """The fastest type of numbers in which inner products of these are exact."""
    top = [max([0, *(int(np.abs(p).max()) for p in group if p.size)]) for group in ((parts[0],), parts[1:])]
    most = top[0] * top[1] * max(size, 1)
    if most >= 1 << 63:
        raise ValueError("a score is too large for a whole number of 64 bits")
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(query, block): no document of the block scores more."""
    kind = _exact(q, low, high, size=q.shape[1])
    q, low, high = q.astype(kind), low.astype(kind), high.astype(kind)
    return (np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T).astype(np.int64)


def _reach(bounds: np.ndarray, least: np.ndarray, kth: np.ndarray, kth_id: np.ndarray) -> np.ndarray:
    """Whether a block may hold a document that comes before the kth: a higher score, or the same and an id that is not larger."""
    return (bounds > kth[:, None]) | ((bounds == kth[:, None]) & (least <= kth_id[:, None]))


def search(shard: _Shard, q: np.ndarray, own: np.ndarray, kth: np.ndarray, kth_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, document, score) of the best k of the shard for each query that come before (kth, kth_id), and how many blocks were scored.

    Blocks are taken by falling bound, 1, 1, 2, 4, ... of each open query at a time; a query is closed when its next block cannot reach its kth.
    """
    kind = _exact(q, shard.x, size=q.shape[1])
    docs, weights = shard.x.astype(kind), q.astype(kind)
    by_least = np.argsort(shard.least, kind="stable")
    bounds = _bounds(q, shard.low, shard.high)[:, by_least]
    order = np.argsort(-bounds, axis=1, kind="stable")
    bounds, order = np.take_along_axis(bounds, order, 1), by_least[order]
    kth, kth_id, still = kth.copy(), kth_id.copy(), np.arange(len(q))
    best = (np.zeros(0, np.int64),) * 3
    place, step, scored = 0, 1, 0
    while len(still) and place < order.shape[1]:
        blocks = order[still, place:place + step]
        reach = (bounds[still, place:place + step] > kth[still, None]) | (
            (bounds[still, place:place + step] == kth[still, None]) & (shard.least[blocks] <= kth_id[still, None]))
        which, column = np.nonzero(reach)
        block = blocks[which, column]
        by_block = np.argsort(block, kind="stable")
        which, block = still[which[by_block]], block[by_block]
        scored += len(block)
        found = [best]
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
        for first, last in zip(starts, np.append(starts[1:], len(block))):
            asked, begin, end = which[first:last], shard.at[block[first]], shard.at[block[first] + 1]
            scores = (weights[asked] @ docs[begin:end].T).astype(np.int64)
            a, b = np.nonzero((scores >= kth[asked, None]) & (shard.r[None, begin:end] != own[asked, None]))
            found.append((asked[a], b + begin, scores[a, b]))
        who, doc, score = (np.concatenate(c) for c in zip(*found))
        by_rank = np.lexsort((shard.r[doc], shard.id[doc], ~shard.known[doc], -score, who))
        who, doc, score = who[by_rank], doc[by_rank], score[by_rank]
        begins = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
        rank = np.arange(len(who)) - np.repeat(begins, np.diff(np.append(begins, len(who))))
        who, doc, score, rank = (c[rank < k] for c in (who, doc, score, rank))
        full = rank == k - 1
        kth[who[full]], kth_id[who[full]] = score[full], np.where(shard.known[doc[full]], shard.id[doc[full]], LAST)
        best = (who, doc, score)
        still = still[reach.all(1)]
        place, step = place + step, min(2 * step if place else 1, 64)
    return *best, scored


_FOUND = "qr long, query_id long, doc long, vec_id long, score long"


def _found(shard: _Shard, who: np.ndarray, doc: np.ndarray, score: np.ndarray, own: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
    return [pa.array(own[who]), pa.array(ids[who]), pa.array(shard.r[doc]), pa.array(shard.id[doc], mask=~shard.known[doc]), pa.array(score)]


def _home(table: pa.Table, size: int, k: int) -> pa.Table:
    """The best k of its own shard for each query, and the query's packed vector in the row of its first rank (or alone)."""
    shard, home = _Shard(table, size), table.column("shard")[0].as_py()
    columns, names = [], [*(f.split()[0] for f in _FOUND.split(", ")), "home", "width", "v", "kth", "kth_id"]
    for first in range(0, int(shard.query.sum()), SLICE):
        at = np.flatnonzero(shard.query)[first:first + SLICE]
        q, own, ids = shard.x[at], shard.r[at], shard.id[at]
        who, doc, score, _ = search(shard, q, own, np.full(len(at), NONE), np.full(len(at), LAST), k)
        hits = np.bincount(who, minlength=len(at))
        kth, kth_id = np.full(len(at), NONE), np.full(len(at), LAST)
        ends = np.append(np.flatnonzero(who[1:] != who[:-1]), len(who) - 1) if len(who) else np.zeros(0, np.int64)
        full = ends[hits[who[ends]] >= k]
        kth[who[full]], kth_id[who[full]] = score[full], np.where(shard.known[doc[full]], shard.id[doc[full]], LAST)
        width = width_of(q)
        blank = lambda n, kind: pa.nulls(n, kind)
        n, m = len(who), len(at)
        got = _found(shard, who, doc, score, own, ids)
        of_query = [pa.array(own), pa.array(ids), blank(m, pa.int64()), blank(m, pa.int64()), blank(m, pa.int64()), pa.array(np.full(m, home, np.int32)),
                    pa.array(np.full(m, width, np.int32)), binary_rows(q, width), pa.array(kth), pa.array(kth_id)]
        of_hits = [*got, blank(n, pa.int32()), blank(n, pa.int32()), blank(n, pa.binary()), blank(n, pa.int64()), blank(n, pa.int64())]
        columns += [pa.Table.from_arrays(of_query, names=names), pa.Table.from_arrays(of_hits, names=names)]
    if columns:
        return pa.concat_tables(columns)
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table({name: pa.array([], kind) for name, kind in zip(names, kinds)})


_ROUTED = "shard int, team int, qr long, query_id long, width int, v binary, kth long, kth_id long"


def _route(blocks: pa.Table, queries: pa.Table, size: int) -> pa.Table:
    """(shard, query) for each shard of the page, but the query's own, in which some block may hold a better document."""
    if not blocks.num_rows or not queries.num_rows:
        return pa.table({c: pa.array([], kind) for c, kind in zip([f.split()[0] for f in _ROUTED.split(", ")],
                                                                  [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()])})
    shards, place = np.unique(blocks.column("shard").to_numpy(), return_inverse=True)
    low, high, least = _ends(blocks, size)
    out = []
    for first in range(0, queries.num_rows, SLICE):
        part = queries.slice(first, SLICE)
        q = matrix(part.column("v"), part.column("width").to_numpy(), size)
        reach = _reach(_bounds(q, low, high), least, part.column("kth").to_numpy(), part.column("kth_id").to_numpy())
        any_block = np.zeros((len(q), len(shards)), bool)
        a, b = np.nonzero(reach)
        any_block[a, place[b]] = True
        any_block[part.column("home").to_numpy()[:, None] == shards[None]] = False
        a, b = np.nonzero(any_block)
        rows = part.take(pa.array(a))
        out.append(pa.Table.from_arrays([pa.array(shards[b].astype(np.int32))] + [rows.column(c) for c in ("team", "qr", "query_id", "width", "v", "kth", "kth_id")],
                                        names=["shard", "team", "qr", "query_id", "width", "v", "kth", "kth_id"]))
    return pa.concat_tables(out)


def _cell(blocks: pa.Table, queries: pa.Table, size: int, k: int) -> pa.Table:
    names, columns = [f.split()[0] for f in _FOUND.split(", ")], []
    shard = _Shard(blocks, size) if blocks.num_rows and queries.num_rows else None
    for first in range(0, queries.num_rows if shard else 0, SLICE):
        part = queries.slice(first, SLICE)
        q, own, ids = matrix(part.column("v"), part.column("width").to_numpy(), size), part.column("qr").to_numpy(), part.column("query_id").to_numpy()
        who, doc, score, _ = search(shard, q, own, part.column("kth").to_numpy(), part.column("kth_id").to_numpy(), k)
        columns.append(pa.Table.from_arrays(_found(shard, who, doc, score, own, ids), names=names))
    return pa.concat_tables(columns) if columns else pa.table({c: pa.array([], pa.int64()) for c in names})


def _one(function, **fixed):
    def of_group(table):
        return function(table, **fixed)
    return of_group


def _two(function, **fixed):
    def of_groups(left, right):
        return function(left, right, **fixed)
    return of_groups


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0, query: str = "id % 20 = 0") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row that `query` (SQL over `id`) names, the k other rows of highest inner product.

    Components count as floor(scale * c). Ties go to the smaller id, a null id last; rows of the same id are candidates of each other and
    queries of their own, ranked for themselves. A row whose condition is null is no query. Vectors that are null or hold null or
    non-finite components take no part; vectors meet only others of their length. Other columns are ignored. An empty table, or one
    without queries, gives no rows.
    """
    rows = packed_vectors(vectors, id_col, vector_col, scale)
    spark, found = rows.sparkSession, None
    for size, count in sizes_of(rows):
        held = rows.where(F.col("size") == size).select("r", "id", F.coalesce(F.expr(query), F.lit(False)).alias("query"), "width", "v")
        sample = held.orderBy(F.xxhash64("r", F.lit(12)), "r").limit(SAMPLE).select("width", "v").toArrow()  # SAMPLE rows at most
        directions, cuts = bisections(matrix(sample.column("v"), sample.column("width").to_numpy(), size).astype(np.float64))
        shards = -(-count // shard_size(count, size))
        placed = held.mapInArrow(partial(_leaves, size=size, directions=directions, cuts=cuts), "r long, id long, query boolean, width int, v binary, leaf int")
        ordered = placed.repartitionByRange(4 * shards, "leaf", "id", "r").sortWithinPartitions("leaf", "id", "r")
        blocks = stored(ordered.mapInArrow(partial(_blocks, size=size), _BLOCKS))
        before, shard_of = 0, []
        for r in sorted(blocks.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["part"]):  # one row per partition
            shard_of.append((r["part"], (2 * before + r["n"] - 1) * shards // (2 * count)))
            before += r["n"]
        blocks = blocks.join(F.broadcast(spark.createDataFrame(shard_of, "part int, shard int")), "part")  # one row per partition

        at_home = stored(blocks.groupBy("shard").applyInArrow(_one(_home, size=size, k=k), f"{_FOUND}, home int, width int, v binary, kth long, kth_id long"))
        hits = at_home.where("doc is not null").select("qr", "query_id", "doc", "vec_id", "score")
        if shards > 1:
            queries = at_home.where("v is not null").select("qr", "query_id", "home", "width", "v", "kth", "kth_id").withColumn("team", F.expr(f"home div {GROUP}").cast("int"))
            pages, teams = -(-shards // PAGE), -(-shards // GROUP)
            maxima = blocks.select(F.expr(f"shard div {PAGE}").cast("int").alias("page"), "shard", "width", "low", "high", "least")
            maxima = maxima.withColumn("team", F.explode(F.sequence(F.lit(0), F.lit(teams - 1))))
            asked = queries.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
            routed = stored(maxima.groupBy("page", "team").cogroup(asked.groupBy("page", "team")).applyInArrow(_two(_route, size=size), _ROUTED))
            pairs = routed.select(F.col("shard").alias("shard"), F.col("team").alias("team")).distinct()  # columns of its own, apart from those of `routed`
            met = blocks.join(pairs, "shard")
            cells = met.groupBy("shard", "team").cogroup(routed.groupBy("shard", "team")).applyInArrow(_two(_cell, size=size, k=k), _FOUND)
            hits = hits.union(cells)
        found = hits if found is None else found.union(hits)
    if found is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    best = Window.partitionBy("qr").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "doc")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score")
