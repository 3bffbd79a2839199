"""Prefix trie of conversations in node tables behind minimal perfect hashes.

Turns are put in order by a range-partitioned scan: each task numbers and sums its own run of rows, and one row per partition reaches the
driver, which tells each partition what stands before it. So a conversation may be longer than a task can hold. The digest of a prefix is
the sum, in two words of 64 bits, of mixed md5 digests of its turns and their places; the last turn's digest and the parent's must agree for
all members of a node, otherwise the job fails, so a collision cannot merge nodes unseen.

A shard is one range of (conversation, depth). In it the distinct prefix digests get slots of a minimal perfect hash, whose slots hold the
digests for verification; members are counted into flat arrays. Counts are merged over the shards by digest. Each node belongs to the shard of its
smallest member, which holds all its ancestors; there what the node adds to its subtree totals is scattered into the flat arrays and
accumulated through the array of parent slots, deepest first. The shards' totals of a node are added. Where a conversation runs on from the
shard before, the end of that run is in the table as a slot without members, and what arrives there is added to the whole run afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.llm.hashing import mix
from gaugewell.llm.shared import bounded_batches, stored

U = np.uint64
IDS = 4_096  # ids in one piece of a node's list of ends


class SlotTable:
    """Minimal perfect hash of distinct 128-bit digests: level by level a digest that is alone at its place keeps it, the others go on.

    A slot holds its digest, so a digest that is not in the table is told apart.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (place is taken, slot of the first taken place before)
        slot, left, used = np.empty(len(a), np.int64), np.arange(len(a)), 0
        while len(left):
            place = self._places(a[left], b[left], len(self.levels), 2 * len(left) + 1)
            alone = np.bincount(place, minlength=2 * len(left) + 1) == 1
            ranks = used + np.cumsum(alone) - alone
            self.levels.append((alone, ranks))
            kept = alone[place]
            slot[left[kept]] = ranks[place[kept]]
            used, left = used + int(alone.sum()), left[~kept]
            if len(self.levels) > 200:
                raise ValueError("digests are not distinct")
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.a[slot], self.b[slot] = a, b

    @staticmethod
    def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a + mix(b + U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))) % U(size)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 where the table does not hold it."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (alone, ranks) in enumerate(self.levels):
            place = self._places(a[left], b[left], level, len(alone))
            here = alone[place]
            slot = ranks[place[here]]
            same = (self.a[slot] == a[left[here]]) & (self.b[slot] == b[left[here]])
            out[left[here][same]] = slot[same]
            left = left[~here]
        return out


# --- scans of ordered rows

def _run_starts(c: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, c[1:] != c[:-1]))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the place of each row among the rows of its conversation in that partition."""
    from pyspark import TaskContext

    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not len(batch):
            continue
        c = batch.column("c").to_numpy()
        starts = _run_starts(c)
        at = np.arange(len(c)) - np.repeat(starts, np.diff(np.append(starts, len(c))))
        if c[0] == last:
            at[c == last] += count
        last, count = c[-1], at[-1] + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part, np.int32)), batch.column("c"), pa.array(at), batch.column("dig"), batch.column("nbytes")],
                                         names=["part", "c", "at", "dig", "nbytes"])


def _words(dig: pa.Array, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words for each turn at its place; the root's are 0."""
    data = np.frombuffer(b"".join(dig.to_pylist()), "<u8").reshape(-1, 2)
    salt = mix(depth.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    a, b = mix(data[:, 0] ^ salt), mix(data[:, 1] + mix(salt))
    return np.where(depth == 0, U(0), a), np.where(depth == 0, U(0), b)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the sums of the turns' words from the conversation's first row in that partition on."""
    from pyspark import TaskContext

    part, last, carry = TaskContext.get().partitionId(), None, (U(0), U(0))
    for batch in batches:
        if not len(batch):
            continue
        c = batch.column("c").to_numpy()
        starts = _run_starts(c)
        sums = []
        for word, before in zip(_words(batch.column("dig"), batch.column("depth").to_numpy()), carry):
            total = np.cumsum(word, dtype=np.uint64)
            total -= np.repeat(total[starts] - word[starts], np.diff(np.append(starts, len(c))))
            if c[0] == last:
                total[c == last] += before
            sums.append(total)
        last, carry = c[-1], (sums[0][-1], sums[1][-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part, np.int32))] + [pa.array(s.view(np.int64)) for s in sums] + list(batch.columns),
                                         names=["part", "s1", "s2", *batch.schema.names])


def _partitions(rows: int) -> int:
    """Up to 64 ranges of at least 2,048 rows, then ranges of 262,144 rows."""
    return max(1, min(64, rows // 2_048), rows // 262_144)


# --- shards

Carries = dict[int, tuple[int, int, int]]  # part: conversation that runs on from the part before, words of its sum so far


def _digests(table: pa.Table, carries: Carries) -> tuple[np.ndarray, np.ndarray]:
    a, b = (table.column(s).to_numpy().view(np.uint64).copy() for s in ("s1", "s2"))
    c, parts = table.column("c").to_numpy(), table.column("part").to_numpy()
    for part in np.unique(parts):
        if int(part) in carries:
            conv, first, second = carries[int(part)]
            runs_on = (c == conv) & (parts == part)
            a[runs_on] += U(first)
            b[runs_on] += U(second)
    return a, b


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of one row for each distinct digest."""
    order = np.lexsort((b, a))
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
    return order[new]


_PARTIAL = "part int, seq int, a long, b long, info struct<depth:long,pa:long,pb:long,dig:binary,nbytes:long>, n long, least long, goes_on boolean, ends string"
_INFO = pa.struct([("depth", pa.int64()), ("pa", pa.int64()), ("pb", pa.int64()), ("dig", pa.binary()), ("nbytes", pa.int64())])


def _count(table: pa.Table, carries: Carries) -> pa.Table:
    """One row per distinct prefix of a shard: members, the smallest of them, what is known of the prefix, and who ends there."""
    table = table.sort_by([("c", "ascending"), ("depth", "ascending")]).combine_chunks()
    part = table.column("part")[0].as_py()
    a, b = _digests(table, carries)
    c, depth, total = (table.column(x).to_numpy() for x in ("c", "depth", "total"))
    first = np.append(True, c[1:] != c[:-1])
    up_a, up_b = np.where(first, U(0), np.roll(a, 1)), np.where(first, U(0), np.roll(b, 1))
    conv, word, other = carries.get(part, (None, 0, 0))
    ghost = conv is not None and c[0] == conv
    if ghost:
        up_a[0], up_b[0] = U(word), U(other)
    keys_a, keys_b = (np.append(x, U(y)) if ghost else x for x, y in ((a, word), (b, other)))
    keys = _distinct(keys_a, keys_b)
    slots = SlotTable(keys_a[keys], keys_b[keys])
    at, size = slots.slots(a, b), len(keys)
    n, least, goes_on, example = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, bool), np.full(size, -1)
    np.add.at(n, at, 1)
    np.minimum.at(least, at, c)
    np.logical_or.at(goes_on, at, depth < total)
    example[at] = np.arange(len(at))
    row = pa.array(np.where(example < 0, 0, example))
    info = pa.StructArray.from_arrays(
        [pa.array(depth).take(row), pa.array(up_a.view(np.int64)).take(row), pa.array(up_b.view(np.int64)).take(row),
         table.column("dig").combine_chunks().cast(pa.binary()).take(row), table.column("nbytes").combine_chunks().take(row)],
        fields=list(_INFO), mask=pa.array(n == 0))
    ending = np.flatnonzero(depth == total)
    ending = ending[np.argsort(at[ending], kind="stable")]
    pieces: list[tuple[int, int, str]] = []
    starts = _run_starts(at[ending]) if len(ending) else np.zeros(0, np.int64)
    for begin, end in zip(starts, np.append(starts[1:], len(ending))):
        for seq, i in enumerate(range(begin, end, IDS)):
            pieces.append((int(at[ending[begin]]), seq, ",".join(map(str, c[ending[i:min(i + IDS, end)]]))))
    lists = dict((slot, ids) for slot, seq, ids in pieces if not seq)
    names = [f.split()[0] for f in ("part int", "seq int", "a long", "b long", "info x", "n long", "least long", "goes_on boolean", "ends string")]
    whole = pa.Table.from_arrays(
        [pa.array(np.full(size, part, np.int32)), pa.array(np.zeros(size, np.int32)), pa.array(slots.a.view(np.int64)), pa.array(slots.b.view(np.int64)), info,
         pa.array(n), pa.array(least, mask=n == 0), pa.array(goes_on), pa.array([lists.get(i) for i in range(size)], pa.string())], names=names)
    more = [(slot, seq, ids) for slot, seq, ids in pieces if seq]
    if not more:
        return whole
    where = np.array([m[0] for m in more])
    blank = pa.nulls(len(more), pa.int64())
    rest = pa.Table.from_arrays(
        [pa.array(np.full(len(more), part, np.int32)), pa.array([m[1] for m in more], pa.int32()), pa.array(slots.a[where].view(np.int64)), pa.array(slots.b[where].view(np.int64)),
         pa.nulls(len(more), _INFO), blank, blank, pa.nulls(len(more), pa.bool_()), pa.array([m[2] for m in more], pa.string())], names=names)
    return pa.concat_tables([whole, rest])


_TOTALS = ("part int, carried boolean, a long, b long, n_leaves long, saved long, n_children long, conv_id long, depth long, parent_conv_id long, n_convs long")


def _accumulate(table: pa.Table) -> pa.Table:
    """Subtree totals of a shard's slots from the nodes that belong to it, deepest first; one row more for what leaves the shard."""
    part = table.column("part")[0].as_py()
    a, b, up_a, up_b = (table.column(x).to_numpy().view(np.uint64) for x in ("a", "b", "pa", "pb"))
    slots = SlotTable(a, b)
    by_slot = np.empty(len(a), np.int64)
    by_slot[slots.slots(a, b)] = np.arange(len(a))
    depth, n, nbytes, n_convs, least, owner = (table.column(x).to_numpy()[by_slot] for x in ("depth", "n", "nbytes", "n_convs", "least", "owner"))
    goes_on = table.column("goes_on").to_numpy(zero_copy_only=False)[by_slot]
    parent = np.where(depth > 0, slots.slots(up_a[by_slot], up_b[by_slot]), -1)
    own = (owner == part) & (n > 0)
    below = own & (depth > 0)
    leaves, saved, children = (own & ~goes_on).astype(np.int64), np.where(below, (n_convs - 1) * nbytes, 0), np.zeros(len(a), np.int64)
    np.add.at(children, parent[below], 1)
    order = np.argsort(-depth, kind="stable")
    starts = _run_starts(depth[order])
    for begin, end in zip(starts, np.append(starts[1:], len(order))):
        level = order[begin:end]
        level = level[parent[level] >= 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    tops = np.flatnonzero((depth > 0) & (parent < 0))
    rows, lone = np.append(np.arange(len(a)), tops), np.append(np.zeros(len(a), bool), np.ones(len(tops), bool))
    named = own[rows] & ~lone
    return pa.Table.from_arrays(
        [pa.array(np.full(len(rows), part, np.int32)), pa.array(lone), pa.array(slots.a[rows].view(np.int64)), pa.array(slots.b[rows].view(np.int64)), pa.array(leaves[rows]),
         pa.array(saved[rows]), pa.array(np.where(lone, 0, children[rows])), pa.array(least[rows], mask=~named), pa.array(depth[rows], mask=~named),
         pa.array(least[parent[rows]], mask=~named | (depth[rows] == 0)), pa.array(n_convs[rows], mask=~named)],
        names=[f.split()[0] for f in _TOTALS.split(", ")])


def _with_digests(batches: Iterator[pa.RecordBatch], carries: Carries) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = _digests(pa.Table.from_batches([batch]), carries)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column("n_leaves"), batch.column("saved")], names=["a", "b", "n_leaves", "saved"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined pieces of each node, in the order of the rows; holds one piece and the state of the hash."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], names=["a", "b", "ends_sha256"])

    for batch in batches:
        done = []
        for a, b, ids in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "ends"))):
            if key == (a, b):
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((*key, state.hexdigest()))
            key, state = (a, b), hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "ends_sha256"])
    if key is not None:
        yield row()


def _one(function, **fixed):
    def of_group(table):
        return function(table, **fixed)
    return of_group


# --- the operator

def _in_order(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Written rows (c, pos, dig, nbytes): the place of each turn in its conversation, from 0."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("dig"),
        F.octet_length(text).cast("long").alias("nbytes"), F.monotonically_increasing_id().alias("r"))
    keys = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("dig"), F.col("r")]
    count = turns.where(F.col(conv_col).isNotNull()).count()
    ordered = stored(bounded_batches(rows.repartitionByRange(_partitions(count), *keys).sortWithinPartitions(*keys).select("c", "dig", "nbytes"))
                     .mapInArrow(_numbered, "part int, c long, at long, dig binary, nbytes long"))
    ends = ordered.groupBy("part").agg(F.min("c").alias("first"), F.max(F.struct("c", "at")).alias("last")).collect()  # one row per partition
    before, last, count = [], None, 0
    for r in sorted(ends, key=lambda r: r["part"]):
        offset = count if r["first"] == last else 0
        if offset:
            before.append((r["part"], r["first"], offset))
        last, count = r["last"]["c"], r["last"]["at"] + 1 + (offset if r["last"]["c"] == r["first"] else 0)
    offsets = ordered.sparkSession.createDataFrame(before, "part int, c long, offset long")
    placed = ordered.join(F.broadcast(offsets), ["part", "c"], "left")  # one row per partition at most
    return placed.select("c", (F.col("at") + F.coalesce("offset", F.lit(0))).alias("pos"), "dig", "nbytes")


def _rebuilt(own: DataFrame, base: Column, head: Column) -> DataFrame:
    """Rows (c, depth, dig, nbytes, total) of the rebuilt conversations, depth 0 being the root; base and head are columns over `c`."""
    convs = own.groupBy("c").agg((F.max("pos") + 1).alias("len")).select("c", "len", base.alias("base"), head.alias("h"))
    convs = stored(convs)
    lengths = convs.select(F.col("c").alias("base"), F.col("len").alias("base_len"))
    taken = F.least("h", F.coalesce("base_len", F.lit(0)))
    convs = stored(convs.join(lengths, "base", "left").select("c", "base", "h", taken.alias("m"), (taken + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("total")))
    rest = own.join(convs.select("c", "h", "m", "total"), "c").where("pos >= h").select("c", (F.col("m") + F.col("pos") - F.col("h") + 1).alias("depth"), "dig", "nbytes", "total")
    most = convs.agg(F.max("h")).first()[0] or 0
    heads = own.where(F.col("pos") < most).select(F.col("c").alias("base"), "pos", "dig", "nbytes").join(convs.select("c", "base", "h", "total"), "base").where("pos < h")
    heads = heads.select("c", (F.col("pos") + 1).alias("depth"), "dig", "nbytes", "total")
    roots = convs.select("c", F.lit(0).cast("long").alias("depth"), F.unhex(F.lit("00" * 16)).alias("dig"), F.lit(0).cast("long").alias("nbytes"), "total")
    return rest.unionByName(heads).unionByName(roots)


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                base: str = "c - c % 5", head: str = "crc32(cast(c as string)) % 9") -> DataFrame:
    """One row per distinct prefix: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c, rebuilt, is the first `head` turns of conversation `base` (SQL over c; all if it has fewer, none if it is absent), then its own
    after its first `head`. Turns are ordered by turn, null first, equal turns by the md5 digest of role and text; repeated rows are turns of
    their own. Null roles and texts are empty. Rows without a conversation id take no part. Other columns are ignored; an empty table has
    no nodes, not even a root. `saved_tokens` counts UTF-8 bytes.
    """
    own = _in_order(turns, conv_col, turn_col, role_col, text_col)
    rows = stored(_rebuilt(own, F.expr(base), F.expr(head)))
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(_partitions(rows.count()), "c", "depth").sortWithinPartitions("c", "depth")
    shards = stored(bounded_batches(ranged).mapInArrow(_summed, "part int, s1 long, s2 long, c long, depth long, dig binary, nbytes long, total long"))

    ends = shards.groupBy("part").agg(F.min("c").alias("first"), F.max(F.struct("c", "depth", "s1", "s2")).alias("last")).collect()  # one row per shard
    ends, carries, word = sorted(ends, key=lambda r: r["part"]), {}, (0, 0)
    for before, r in zip([None, *ends], ends):
        runs_on = before is not None and before["last"]["c"] == r["first"]
        if runs_on:
            carries[r["part"]] = (r["first"], *word)
        word = tuple((r["last"][s] + (w if runs_on and r["last"]["c"] == r["first"] else 0)) % (1 << 64) for s, w in zip(("s1", "s2"), word))

    counted = stored(shards.groupBy("part").applyInArrow(_one(_count, carries=carries), _PARTIAL))
    node = Window.partitionBy("a", "b")
    known = F.max("info").over(node)
    agreed = F.when(F.min("info").over(node) == known, known).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("struct<depth:long,pa:long,pb:long,dig:binary,nbytes:long>"))
    merged = counted.where("seq = 0").select(
        "part", "a", "b", "n", agreed.alias("info"), F.sum("n").over(node).alias("n_convs"), F.max("goes_on").over(node).alias("goes_on"),
        F.min(F.when(F.col("n") > 0, F.struct("least", "part"))).over(node).alias("owner"))
    merged = merged.select("part", "a", "b", "n", "info.depth", "info.pa", "info.pb", "info.nbytes", "n_convs", "goes_on", "owner.least", F.col("owner.part").alias("owner"))
    totals = stored(merged.groupBy("part").applyInArrow(_one(_accumulate), _TOTALS))

    sums = totals.where("not carried").drop("part", "carried")
    left = {r["part"]: (r["n_leaves"], r["saved"]) for r in totals.where("carried").collect()}  # one row per shard at most
    added, beyond = [], (0, 0)
    for before, r in reversed(list(zip(ends, ends[1:]))):
        if before["last"]["c"] != r["first"]:
            continue
        after = beyond if r["last"]["c"] == r["first"] else (0, 0)
        whole = tuple(x + y for x, y in zip(left.get(r["part"], (0, 0)), after))
        if any(whole):
            added.append((before["part"], r["first"], before["last"]["depth"], *whole, *after))
        beyond = whole
    if added:
        runs = F.broadcast(spark.createDataFrame(added, "part int, c long, until long, n_leaves long, saved long, last_leaves long, last_saved long"))
        at_end = F.col("depth") == F.col("until")
        extra = shards.select("part", "c", "depth", "s1", "s2").join(runs, ["part", "c"]).select(
            "part", "c", "s1", "s2", F.when(at_end, F.col("last_leaves")).otherwise(F.col("n_leaves")).alias("n_leaves"), F.when(at_end, F.col("last_saved")).otherwise(F.col("saved")).alias("saved"))
        sums = sums.unionByName(extra.mapInArrow(partial(_with_digests, carries=carries), "a long, b long, n_leaves long, saved long"), allowMissingColumns=True)

    nodes = sums.groupBy("a", "b").agg(*(F.max(x).alias(x) for x in ("conv_id", "depth", "parent_conv_id", "n_convs")), F.sum("n_children").alias("n_children"),
                                       F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    lists = counted.where("ends is not null").select("a", "b", "part", "seq", "ends").repartition("a", "b").sortWithinPartitions("a", "b", "part", "seq")
    nodes = nodes.join(lists.mapInArrow(_listed, "a long, b long, ends_sha256 string"), ["a", "b"], "left")
    return nodes.select(F.col("conv_id").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
