"""Conversation trie, exact top-k and whitening against brute force, with shards small enough that runs and groups are cut."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from gaugewell.llm import prefix_trie as trie
from gaugewell.llm import topk_search as search
from gaugewell.llm import whitening

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:])
    nodes: dict[tuple, list] = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    children, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for node in sorted(nodes, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(nodes[node]) - 1) * len(node[-1][1].encode()) if node else 0
        if node:
            children[node[:-1]] += 1
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    out = []
    for node, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(rebuilt[c]) == len(node)))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def run_trie(spark, rows):
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS c", "2 AS depth", "'x' AS part")
    return sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=lambda r: (r[0], r[1]))


def conversations(seed, n, words, longest):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(1, longest))):
            rows.append((c * 3 - 20, None if t == 3 else t, rng.choice(["user", "assistant", None]) if words > 2 else "user", [None, "", "häß", "a b", "z" * 50][int(rng.integers(0, words))]))
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_trie_against_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(trie, "_partitions", lambda rows: parts)
    rows = conversations(parts, 60, 2, 9) + [(1000 + i, t, "user", "same") for i in range(25) for t in range(4)] + [(None, 1, "user", "no conversation")]
    assert run_trie(spark, rows) == brute_trie(rows)


def test_trie_of_conversations_longer_than_shards(spark, monkeypatch):
    monkeypatch.setattr(trie, "_partitions", lambda rows: 6)
    monkeypatch.setattr(trie, "IDS", 3)
    long = [(0, t, "user", f"turn {t}") for t in range(300)]
    copies = [(c, t, "user", f"turn {t}" if t < 200 + c else "else") for c in (5, 10) for t in range(260)]
    rows = long + copies + [(20 + 5 * i, 0, "user", "hello") for i in range(20)] + [(7, 1, None, None), (7, 1, None, None)]
    assert run_trie(spark, rows) == brute_trie(rows)


def test_trie_edges(spark):
    assert run_trie(spark, []) == []
    assert run_trie(spark, [(None, 1, "a", "b")]) == []
    for rows in ([(5, None, None, None)], [(6, 1, "a", "b"), (6, 2, "c", "d" * 100_000)], [(3, 1, "u", "t"), (3, 1, "u", "t"), (3, None, "u", "")]):
        assert run_trie(spark, rows) == brute_trie(rows)


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        a, b = rng.integers(0, 1 << 63, (2, n)).astype(np.uint64)
        table = trie.SlotTable(a, b)
        assert sorted(table.slots(a, b)) == list(range(n))
        assert (table.slots(a + np.uint64(1), b) == -1).all()
    with pytest.raises(ValueError):
        trie.SlotTable(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


VECTORS = "vec_id long, embedding array<double>"


def vectors(seed, n, size, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size)) * 0.2
    x[:copies] = x[0]
    ids = rng.permutation(n)
    return [(int(i), [float(c) for c in v]) for i, v in zip(ids, x)]


def table(spark, rows):
    return spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' AS r", "1 AS id", "2 AS score", "3 AS shard")


def brute_top(rows, k=20):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    whole = [[int(np.floor(64 * c)) for c in v] for _, v in kept]
    out = []
    for q, (i, _) in enumerate(kept):
        if i is None or i % 20:
            continue
        scored = [(-sum(a * b for a, b in zip(whole[q], whole[d])), kept[d][0] is None, kept[d][0] or 0) for d in range(len(kept)) if d != q and len(whole[d]) == len(whole[q])]
        out += [(i, r + 1, None if none else v, -s) for r, (s, none, v) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def run_top(spark, rows):
    return sorted((tuple(r) for r in search.top_k(table(spark, rows)).collect()), key=repr)


@pytest.mark.parametrize("shard", [10_000, 150])
def test_top_k_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(search, "shard_size", lambda count, size: shard)
    monkeypatch.setattr(search, "GROUP", 2)
    monkeypatch.setattr(search, "PAGE", 3)
    monkeypatch.setattr(search, "BLOCK", 16)
    rows = vectors(3, 900, 12, copies=300)
    rows[5], rows[6] = (rows[5][0], None), (rows[6][0], [None] + rows[6][1][1:])
    rows[7] = (rows[7][0], [float("nan")] * 12)
    rows += [(None, rows[0][1]), (2000, rows[0][1]), (2000, rows[1][1]), (40_000, [0.5]), (40_001, [2.0]), (40_020, [])]
    assert run_top(spark, rows) == brute_top(rows)


def test_top_k_edges(spark):
    assert run_top(spark, []) == []
    assert run_top(spark, [(1, [1.0]), (None, [1.0]), (20, None)]) == []
    large = [(0, [1e7, -3e6 - 0.01]), (1, [2e5, 1.0]), (2, [-1e7 + 0.02, 0.0])]  # beyond what doubles add exactly
    assert run_top(spark, large) == brute_top(large)
    with pytest.raises(Exception, match="too large"):
        run_top(spark, [(0, [1e300]), (1, [1.0])])


def test_blocks_that_cannot_reach_the_kth_are_not_scored():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    centres = rng.integers(-60, 60, (20, 16))
    x = np.repeat(centres, 32, 0) + rng.integers(-2, 3, (640, 16))
    rows = pa.table({"r": np.arange(640), "id": np.arange(640), "query": np.zeros(640, bool), "width": np.full(640, 1), "v": search.binary_rows(x, 1)})
    blocks = [search._block(rows.slice(i, 32), 16, 0, i // 32) for i in range(0, 640, 32)]
    shard = search._Shard(pa.Table.from_batches(blocks), 16)
    none, last = np.full(640, search.NONE), np.full(640, search.LAST)
    who, doc, score, scored = search.search(shard, x, np.arange(640), none, last, 5)
    for q in range(0, 640, 37):
        want = sorted((-int(x[q] @ x[d]), d) for d in range(640) if d != q)[:5]
        assert [(-s, d) for d, s in zip(doc[who == q], score[who == q])] == want
    assert scored < 640 * 20 / 2


def test_jacobi_davidson_against_dense_eigenvectors():
    rng = np.random.default_rng(5)
    for size, wanted in ((1, 1), (7, 3), (64, 32), (180, 32), (150, 4)):
        y = rng.normal(size=(2 * size + 2, size)) * np.linspace(1, 3, size)
        v = y.T @ y / len(y)
        values, axes = whitening.jacobi_davidson(lambda w: v @ w, size, wanted)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:wanted], rtol=1e-13)
        assert np.linalg.norm(v @ axes - axes * values, axis=0).max() < 1e-12 * values[0]
        assert np.abs(axes.T @ axes - np.eye(wanted)).max() < 1e-13
    a, b = y[:100, :100] + y[:100, :100].T, rng.normal(size=(100, 3))
    assert np.abs(a @ whitening.minres(lambda w: a @ w, b, 300, 1e-13) - b).max() < 1e-8


def test_whitening_against_brute_force(spark):
    rows = vectors(8, 700, 40, copies=200)
    rows += [(9000, None), (9001, [None] * 40), (9002, [float("inf")] * 40), (None, rows[3][1]), (rows[4][0], rows[4][1]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0]), (4, [])]
    kept = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in rows if v and len(v) == 40 and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], object)
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    want = centred @ axes[:, :32] / np.sqrt(values[:32])
    found = whitening.whiten(table(spark, rows)).toPandas()
    assert sorted(found.columns) == sorted(["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    assert len(found) == 32 * n and set(found.n) == {n} and found.identity_error.max() < 1e-12
    for c in range(32):
        of = found[found.component == c + 1]
        assert np.allclose(of.explained, values[c] / values.sum(), rtol=1e-12)
        assert np.allclose(sorted(of.whitened.abs()), sorted(np.abs(want[:, c])), atol=1e-10)
    exact = {i: int(((n * np.array(v, object) - sums) ** 2).sum()) for i, v in kept}
    assert all(exact[int(i) if i == i else None] == d for i, d in zip(found.vec_id, found.deviation))


def test_whitening_edges(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, None)], [(1, [0.5, 0.5]), (2, [0.5, 0.5])], [(1, []), (2, [])]):
        assert whitening.whiten(table(spark, rows)).collect() == []
    one = whitening.whiten(table(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 1.0])])).collect()
    assert [r.component for r in one] == [1, 1, 1] and np.allclose(sorted(r.whitened for r in one), [-1.5 ** 0.5, 0, 1.5 ** 0.5]) and np.isclose(one[0].explained, 1.0)
