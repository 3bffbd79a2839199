"""N-gram Jaccard join with signature trees.

Two documents link when the Jaccard similarity of their sets of k-word shingles reaches num / den. The join is exact: every link is
verified and counted, so none is lost and none is invented (sets are compared as 64-bit hashes of shingles). A caller that wants
components alone can leave out the pairs that are connected already.

1. Every text becomes a set; equal sets are one class from here on, so a group of exact copies costs one row.
2. A set of n shingles with a link misses at most n - ceil(t n) shingles in its partner. Shingles in a fixed quarter of the
   hash space are counted over the corpus; documents with more shingles of their own than that link with nothing and leave. This
   is done once more among those that stay.
3. The rest order their shingles by rarity. Linked sets share one of their first n - ceil(t n) + 1, so shingles in these prefixes
   gather sets into families, by connected components. A family is a forest of signature trees.
4. A family is dealt into blocks of bounded size, by size band and then by hash. A task builds a signature tree over each of its
   blocks: nodes hold the OR of the members' shingle bitmaps and their size range. Dual traversal descends into pairs of nodes
   whose size ranges and maximum possible overlap allow a link; pairs of sets that survive are compared exactly. A task sums the
   links of each set, weighted by the copies of the partner, and sends them with a spanning forest, so rows do not grow with pairs.
5. Each two blocks of a family whose size ranges allow a link meet in the same way.

For components alone (links=False) pairs that are connected already are passed over. Families of several blocks then meet in two
rounds: each block with the first block of its band and of the next one, then the sets outside the family's largest component with
every block. A pair of sets that never meets is connected already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.hashing import documents_words, mix, shingles
from gaugewell.llm.shared import bounded_batches, components, cut, release, small, stored

BLOCK_SHINGLES, BLOCK_SETS, LEAF, FANOUT, FRONTIER = 400_000, 2_000, 8, 8, 16_384
COMPARED_BYTES = 4 << 20  # of bitmaps that are combined at once
_QUARTER = np.uint64(1 << 62)


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set that do not depend on its order."""
    with np.errstate(over="ignore"):
        a, b = mix(tokens).sum(dtype=np.uint64), mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch], k: int, whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        at, rows, size = [], [], 0
        for i, words in documents_words(texts, lower=True):
            tokens = shingles(words, k)
            rows.append((len(tokens), *_digest(tokens), tokens if whole else tokens[:np.searchsorted(tokens, _QUARTER)]))
            at.append(i)
            size += len(rows[-1][3])
            if size > 1 << 20 or i == len(texts) - 1:
                n, h1, h2, kept = zip(*rows)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
                tokens_column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), tokens_column],
                    names=["id", "n", "h1", "h2", "tokens"])
                at, rows, size = [], [], 0


_SET_SCHEMA = "id long, n long, h1 long, h2 long, tokens array<long>"


class Tree:
    """Sets sorted by size, and over them levels of nodes with OR-combined bitmaps and size ranges; node i covers FANOUT below."""

    def __init__(self, ids: np.ndarray, tokens: list[np.ndarray], roots: np.ndarray, width: int, copies: np.ndarray | None = None):
        order = sorted(range(len(ids)), key=lambda i: (len(tokens[i]), tokens[i][0] if len(tokens[i]) else 0, ids[i]))
        self.ids, self.tokens, self.roots = ids[order], [tokens[i] for i in order], roots[order]
        self.copies = np.ones(len(ids), np.int64) if copies is None else copies[order]
        n = np.array([len(t) for t in self.tokens], np.int64)
        bits = np.zeros((len(n), width // 64), np.uint64)
        for row, t in zip(bits, self.tokens):
            cell = t % np.uint64(width)
            np.bitwise_or.at(row, (cell >> np.uint64(6)).astype(np.int64), np.uint64(1) << (cell & np.uint64(63)))
        hidden = n - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, n, n, hidden)]
        step = LEAF
        while len(self.levels[-1][1]) > 1:
            bits, low, high, hidden = self.levels[-1]
            at = np.arange(0, len(low), step)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(hidden, at)))
            step = FANOUT

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in node, child) for all children one level below."""
        step, below = (LEAF if level == 1 else FANOUT), len(self.levels[level - 1][1])
        child = node[:, None] * step + np.arange(step)
        at, _ = np.nonzero(child < below)
        return at, child[child < below]


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _common_bits(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that rows a of x and b of y have in common; wide bitmaps are combined a few pairs at a time."""
    out, step = np.empty(len(a), np.int64), max(1, COMPARED_BYTES // (8 * x.shape[1]))
    for i in range(0, len(a), step):
        out[i:i + step] = np.bitwise_count(x[a[i:i + step]] & y[b[i:i + step]]).sum(1, dtype=np.int64)
    return out


def _overlaps(x: Tree, y: Tree) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives the exact number of common shingles for pairs (set of x, set of y), sorted by the first."""
    n_x, n_y = x.levels[0][1], y.levels[0][1]
    distinct, codes = np.unique(np.concatenate([*x.tokens, *y.tokens]), return_inverse=True)
    begin_x, begin_y = np.cumsum(n_x) - n_x, n_x.sum() + np.cumsum(n_y) - n_y
    marked = np.zeros(len(distinct), bool)

    def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, cuts = np.zeros(len(a), np.int64), np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = codes[begin_x[a[low]]:begin_x[a[low]] + n_x[a[low]]]
            marked[own] = True
            sizes = n_y[b[low:high]]
            ends = np.cumsum(sizes)
            hits = np.append(0, np.cumsum(marked[codes[np.repeat(begin_y[b[low:high]] - (ends - sizes), sizes) + np.arange(ends[-1])]]))
            out[low:high] = hits[ends] - hits[ends - sizes]
            marked[own] = False
        return out

    return overlaps


def dual_traversal(x: Tree, y: Tree | None, num: int, den: int, counts: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Verified links (id, id) that connect what is connected among the sets of x, or between those of x and y: a spanning forest.

    With counts, zeros for the sets of x and of y (or twice those of x), all links are verified, and the copies of each set's
    partners are added to its count. Without, pairs that are connected already are passed over.
    """
    other = y if y is not None else x
    overlaps = _overlaps(x, other) if counts else None
    labels, parent = np.unique(np.concatenate([x.roots, other.roots]), return_inverse=True)
    parent_of = np.arange(len(labels))
    at_x, at_y = parent[:len(x.ids)], parent[len(x.ids):]
    links: list[tuple[int, int]] = []
    stack = [(len(x.levels) - 1, len(other.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        i, j, a, b = stack.pop()
        if len(a) > FRONTIER:
            stack += [(i, j, a[:-FRONTIER], b[:-FRONTIER]), (i, j, a[-FRONTIER:], b[-FRONTIER:])]
            continue
        (bits_x, low_x, high_x, hid_x), (bits_y, low_y, high_y, hid_y) = x.levels[i], other.levels[j]
        fits = (den * high_x[a] >= num * low_y[b]) & (den * high_y[b] >= num * low_x[a])
        if y is None and i == j:
            fits &= a <= b if i else a < b
        a, b = a[fits], b[fits]
        most = _common_bits(bits_x, bits_y, a, b) + np.minimum(hid_x[a], hid_y[b])
        most = np.minimum(most, np.minimum(high_x[a], high_y[b]))
        fits = (num + den) * most >= num * (low_x[a] + low_y[b])
        a, b = a[fits], b[fits]
        if i == 0 and j == 0 and counts:
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            common, both = overlaps(a, b), low_x[a] + low_y[b]
            linked = den * common >= num * (both - common)
            a, b = a[linked], b[linked]
            np.add.at(counts[0], a, other.copies[b])
            np.add.at(counts[1], b, x.copies[a])
            for p, q in zip(a.tolist(), b.tolist()):
                r, s = _find(parent_of, at_x[p]), _find(parent_of, at_y[q])
                if r != s:
                    parent_of[max(r, s)] = min(r, s)
                    links.append((int(x.ids[p]), int(other.ids[q])))
            continue
        if i == 0 and j == 0:
            for p, q in zip(a.tolist(), b.tolist()):
                r, s = _find(parent_of, at_x[p]), _find(parent_of, at_y[q])
                if r == s or x.ids[p] == other.ids[q]:
                    continue
                one, two = x.tokens[p], other.tokens[q]
                common = len(one) + len(two) - len(np.union1d(one, two))
                if den * common >= num * (len(one) + len(two) - common):
                    parent_of[max(r, s)] = min(r, s)
                    links.append((int(x.ids[p]), int(other.ids[q])))
            continue
        if (i == 1 or j == 1) and not counts:  # just above the sets: leave out what is connected already
            now = np.array([_find(parent_of, k) for k in range(len(labels))])
            fits = _one(now[at_x], i, a, -1) != _one(now[at_y], j, b, -2)
            a, b = a[fits], b[fits]
        if len(a) and i >= j:
            at, a = x.children(i, a)
            b = b[at]
            i -= 1
            if j > i:
                at, b = other.children(j, b)
                a = a[at]
                j -= 1
        elif len(a):
            at, b = other.children(j, b)
            a = a[at]
            j -= 1
        if len(a):
            stack.append((i, j, a, b))
    return links


def _one(component: np.ndarray, level: int, node: np.ndarray, several: int) -> np.ndarray:
    """The component that all members of a node are in, or `several`."""
    step = LEAF * FANOUT ** (level - 1) if level else 1
    at = np.arange(0, len(component), step)
    low, high = np.minimum.reduceat(component, at), np.maximum.reduceat(component, at)
    return np.where(low == high, low, several)[node]


def _tree(pdf: pd.DataFrame, width: int) -> Tree:
    return Tree(pdf["id"].to_numpy(np.int64), [np.frombuffer(t, np.uint64) for t in pdf["tokens"]], pdf["root"].to_numpy(np.int64), width, pdf["copies"].to_numpy(np.int64))


def _width(*frames: pd.DataFrame) -> int:
    """Bits of a signature: about four for each shingle of the middle set, 64 at least."""
    middle = max(int(f["n"].median()) for f in frames)
    return 1 << min(15, max(6, (4 * middle - 1).bit_length()))


_LINKS = "a long, b long, n long"  # a spanning link of a and b with n = 0, or with a = b the n links of a


def _found(x: Tree, y: Tree | None, num: int, den: int, every: bool) -> pd.DataFrame:
    if not every:
        rows = dual_traversal(x, y, num, den)
        return pd.DataFrame(rows, columns=["a", "b"], dtype="int64").assign(n=0)
    counts = np.zeros(len(x.ids), np.int64), np.zeros(len((y or x).ids), np.int64)
    rows = dual_traversal(x, y, num, den, counts)
    sums = [pd.DataFrame({"a": t.ids[c > 0], "b": t.ids[c > 0], "n": c[c > 0]}) for t, c in zip((x, y or x), counts)]
    return pd.concat([pd.DataFrame(rows, columns=["a", "b"], dtype="int64").assign(n=0), *sums]).astype("int64")


def _within(pdf: pd.DataFrame, num: int, den: int, every: bool) -> pd.DataFrame:
    return _found(_tree(pdf, _width(pdf)), None, num, den, every)


def _between(left: pd.DataFrame, right: pd.DataFrame, num: int, den: int, every: bool) -> pd.DataFrame:
    if left.empty or right.empty:
        return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
    width = _width(left, right)
    return _found(_tree(left, width), _tree(right, width), num, den, every)


def _blocks(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(family, id, n) with a block: a small family is one block; a larger one is cut by size band, then by hash of the id."""
    whole = sets.groupBy("family").agg(F.sum("n").alias("w"), F.count("*").alias("c"))
    banded = sets.join(whole, "family").withColumn(
        "band", F.when((F.col("w") <= BLOCK_SHINGLES) & (F.col("c") <= BLOCK_SETS), F.lit(0))
        .otherwise(F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)))).cast("int")).drop("w", "c")
    bands = banded.groupBy("family", "band").agg(F.sum("n").alias("w"), F.count("*").alias("c")).withColumn(
        "parts", F.greatest(F.ceil(F.col("w") / BLOCK_SHINGLES), F.ceil(F.col("c") / BLOCK_SETS)).cast("int")).drop("w", "c")
    return banded.join(bands, ["family", "band"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")


def _meet(left: DataFrame, right: DataFrame, pairs: DataFrame, num: int, den: int, every: bool) -> DataFrame:
    """Links between the blocks named by pairs (lk, rk); both sides have a column k, and each row travels once per pair."""
    numbered = pairs.withColumn("pair", F.xxhash64("lk", "rk"))
    columns = ["pair", "id", "n", "copies", "root", "tokens"]
    a = left.select("k", *columns[1:]).join(numbered.select("pair", F.col("lk").alias("k")), "k").select(columns)
    b = right.toDF(*right.columns).select("k", *columns[1:]).join(numbered.select("pair", F.col("rk").alias("k")), "k").select([F.col(c).alias(c) for c in columns])
    return a.groupBy("pair").cogroup(b.groupBy("pair")).applyInPandas(partial(_between, num=num, den=den, every=every), _LINKS)


def _reach(left: DataFrame, right: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (lk, rk) of blocks of a family whose size ranges allow a link."""
    one = left.groupBy("family", "band", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    two = right.groupBy("family", "band", "part").agg(F.min("n").alias("from_n"), F.max("n").alias("to_n"))
    one = one.select("family", F.struct("family", "band", "part").alias("lk"), "low", "high")
    two = two.select("family", F.struct("family", "band", "part").alias("rk"), "from_n", "to_n")
    return one.join(two, "family").where(f"{den} * high >= {num} * from_n and {den} * to_n >= {num} * low").select("lk", "rk")


def _links(members: DataFrame, num: int, den: int, every: bool) -> DataFrame:
    """Spanning links inside families, and with every the links of each set. members: family, id, n, copies, tokens (binary)."""
    blocks = cut(_blocks(members.select("family", "id", "n"), num, den))
    payload = members.select("id", "copies", "tokens")
    full = blocks.join(payload, "id").withColumn("k", F.struct("family", "band", "part"))
    links = cut(full.withColumn("root", F.col("id")).groupBy("family", "band", "part").applyInPandas(partial(_within, num=num, den=den, every=every), _LINKS))
    names = cut(blocks.select(F.struct("family", "band", "part").alias("k")).distinct())
    large = names.groupBy("k.family").count().where("count > 1").select("family")
    if large.isEmpty():
        return links
    if every:
        rooted = full.withColumn("root", F.col("id"))
        pairs = cut(_reach(blocks, blocks, num, den).where("lk < rk"))
        return cut(links.union(_meet(rooted, rooted, pairs, num, den, True)))
    # each block with the first block of its own band and of the next
    pairs = names.select(F.col("k").alias("lk"), F.explode(F.array(
        F.struct("k.family", "k.band", F.lit(0).alias("part")), F.struct("k.family", (F.col("k.band") + 1).alias("band"), F.lit(0).alias("part")))).alias("rk"))
    pairs = pairs.join(names.withColumnRenamed("k", "rk"), "rk").where("lk <> rk").join(large, F.col("lk.family") == large["family"], "left_semi")
    rooted = _rooted(full, links)
    links = cut(links.union(_meet(rooted, _rooted(full, links), pairs, num, den, False)))
    # what is outside the largest component of its family, with every block
    rooted = _rooted(full, links)
    sizes = rooted.join(large, "family", "left_semi").groupBy("family", "root").count()
    main = sizes.groupBy("family").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    rest = cut(_blocks(rooted.join(main, "family").where("root <> main").select("family", "id", "n", "root"), num, den))
    if rest.isEmpty():
        return links
    # a block of the rest may hold several bands where the rest is small, so it goes to all blocks its sizes reach
    pairs = _reach(rest, blocks, num, den)
    rest = rest.join(payload, "id").withColumn("k", F.struct("family", "band", "part"))
    return cut(links.union(_meet(rest, rooted, pairs, num, den, False)))


def _rooted(full: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links).select(F.col("node").alias("id"), F.col("component").alias("found"))
    return full.join(found, "id", "left").withColumn("root", F.coalesce("found", "id")).drop("found")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100, links: bool = True) -> DataFrame:
    """One row per input row: id, n_shingles, n_links, component_id, kept.

    Words are lower-cased (A-Z) runs of characters other than space and 0x09-0x0D. Sets link when den * |both| >= num * |either|.
    n_links is the number of other rows that the row links with; links=False leaves the column and pairs that are connected already
    out. component_id is the smallest id reachable by links, kept tells whether that is the row itself. Null and empty texts, and texts
    without words, have no shingles and link with nothing; fewer than k words are one shingle. Rows that repeat an id or have none
    each get a row and link like any other. A null id is never the smallest; a row whose whole component has null ids has a null
    component and is kept. Other columns are ignored. An empty table gives an empty result.
    """
    missing = f"(n - floor(({num} * n + {den} - 1) / {den}))"  # shingles that a linked set may lack in its partner
    source = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = stored(source.mapInArrow(partial(_sets, k=k, whole=False), _SET_SCHEMA).drop("tokens"))
    classes = sets.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    able = f"{den} * n >= {num} * (n + 1)"  # smaller sets link with equal ones only
    open_classes, wanted = classes.where(able), source
    for _ in range(2):  # the second time among those that are left
        quarters = wanted.mapInArrow(partial(_sets, k=k, whole=False), _SET_SCHEMA).where(able)
        # 48 bits of a hash: two shingles that fall together only look less rare, and the shuffle is smaller
        rare = (quarters.select("h1", F.explode("tokens").alias("token")).groupBy(F.shiftright("token", 14).alias("token")).agg(F.min("h1").alias("h1"), F.max("h1").alias("other"))
                .where("h1 = other").groupBy("h1").agg(F.count("*").alias("own")))
        open_classes = cut(open_classes.join(rare, "h1", "left").where(f"coalesce(own, 0) <= {missing}").drop("own"))
        ids = small(cut(open_classes.select(F.col("first").alias("one")).distinct()))
        wanted = source.join(ids, F.col("id").eqNullSafe(F.col("one")), "left_semi")
    whole = wanted.mapInArrow(partial(_sets, k=k, whole=True), _SET_SCHEMA).drop("n")
    whole = whole.join(small(open_classes), ["h1", "h2"]).where("id <=> first").select(F.col("node").alias("id"), "n", "copies", "tokens")
    repeated = sets.groupBy("id").count().where("count > 1")
    nodes = stored(whole if repeated.isEmpty() else whole.dropDuplicates(["id"]))
    postings = nodes.select("id", "n", F.explode("tokens").alias("token"))
    common = postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = postings.join(common, "token").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("held"))
    # shingles of one set only come first in the order of rarity and lead nowhere
    prefix = shared.withColumn("open", F.expr(f"{missing} + 1 - (n - size(held))")).where("open > 0")
    prefix = prefix.select("id", F.explode(F.expr("transform(slice(held, 1, int(open)), x -> x.token)")).alias("token"))
    prefix = cut(prefix)
    first = prefix.groupBy("token").agg(F.min("id").alias("a"), F.count("*").alias("c")).where("c > 1").drop("c")
    family = components(prefix.join(first, "token").select("a", F.col("id").alias("b")))
    members = nodes.join(family.select(F.col("node").alias("id"), F.col("component").alias("family")), "id")
    members = stored(members.mapInArrow(_binary, "family long, id long, n long, copies long, tokens binary"))
    release(nodes)
    found = _links(members, num, den, links)
    # settled in a table of its own, else the last job holds many small joins at once
    linked = components(found.select("a", "b")).select("node", F.col("component").alias("root"))
    linked = cut(linked.join(classes.select("node", "first"), "node"))
    least = linked.groupBy("root").agg(F.min("first").alias("found"))
    roots = classes.join(linked.drop("first").join(least, "root").select("node", "found"), "node", "left")
    roots = roots.join(found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others")), "node", "left")
    roots = roots.select("h1", "h2", F.coalesce("found", "first").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sets.select("id", "n", "h1", "h2").join(roots, ["h1", "h2"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), *[F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] * links,
                      component.alias("component_id"), F.coalesce(component == F.col("id"), F.col("component").isNull()).alias("kept"))


def _binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token lists as bytes, which pandas groups hand over without making Python numbers."""
    for b in batches:
        tokens = b.column(b.schema.get_field_index("tokens"))
        values = tokens.flatten().to_numpy(zero_copy_only=False).astype("<i8", copy=False)
        cuts = np.cumsum(np.concatenate([[0], tokens.value_lengths().to_numpy(zero_copy_only=False)]))
        packed = pa.array([values[cuts[i]:cuts[i + 1]].tobytes() for i in range(len(tokens))], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("family", "id", "n", "copies")] + [packed], names=["family", "id", "n", "copies", "tokens"])
