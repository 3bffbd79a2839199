"""Each operator against a brute-force version or the library it must agree with, with nulls, empties, long texts, ties and repeats."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import gaugewell.llm.embedding_dedup as embedding_dedup
import gaugewell.llm.lm_scoring as lm_scoring
import gaugewell.llm.ngram_join as ngram_join
import gaugewell.llm.packing as packing
import gaugewell.llm.toxicity as toxicity
from gaugewell.llm.bpe import decode, encode
from gaugewell.llm.fingerprints import edited_fingerprints
from gaugewell.llm.html_extract import default_model, extract, main_text
from gaugewell.llm.quality import fit as fit_quality
from gaugewell.llm.quality import score_quality
from gaugewell.llm.queries import QUERIES
from gaugewell.llm.shared import components
from gaugewell.llm.substring_dedup import substring_dedup
from gaugewell.llm.toxicity import fit as fit_toxicity
from gaugewell.llm.toxicity import score_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [(0, None), (1, ""), (2, " \n\t"), (3, "a b"), (4, "A b"), (5, "a b c d")]


def copies(seed: int, groups: int, words: int = 60) -> list[tuple[int, str]]:
    """Random texts in groups of near copies, after the edge cases."""
    rng, rows = random.Random(seed), list(EDGES)
    vocabulary = [f"w{i}" for i in range(words)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 8, 10, 20, 40, 120]))]
        for _ in range(rng.choice([1, 2, 6])):
            x = list(base)
            for _ in range(rng.randrange(0, max(2, len(x) // 15))):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(x)))
    return rows


def smallest_reachable(n: int, links: list[tuple[int, int]]) -> list[int]:
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(30, 31), (40, 40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30}


def test_components_take_few_tasks(spark):
    """The driver keeps books on every task: over 7 partitions these links took 503, with a round that only found nothing changed."""
    links = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(40, 400)]
    table = spark.createDataFrame(links, "a long, b long").repartition(7).localCheckpoint()
    context, held = spark.sparkContext, {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("components", "")
        got = {r.node: r.component for r in components(table).collect()}
    finally:
        context._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: 1 for i in range(1, 31)} | {i: 40 for i in range(40, 400)}
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    assert 0 < sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i) < 420


@pytest.mark.parametrize("block", [(400_000, 2_000), (500, 5)])
def test_jaccard_join_is_exact(texts, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block[0])
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block[1])
    rows = copies(1, 15)
    rows.append((len(rows), rows[-1][1]))
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()})
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = smallest_reachable(len(rows), links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in ngram_join.jaccard_join(texts(rows)).collect()}
    assert got == {i: (len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, want))}


def test_jaccard_join_edges(texts):
    assert ngram_join.jaccard_join(texts([])).count() == 0
    rows = [(None, "a b c d e f g h"), (7, "a b c d e f g h"), (7, "a b c d e f g h"), (None, "q r s t u v w x")]
    got = sorted(repr((r.doc_id, r.component_id, r.kept)) for r in ngram_join.jaccard_join(texts(rows)).collect())
    assert got == sorted(map(repr, [(None, 7, False), (7, 7, True), (7, 7, True), (None, None, True)]))


@pytest.mark.parametrize("block", [(400_000, 2_000), (2_000, 8)])
def test_jaccard_join_counts_every_link(texts, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block[0])
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block[1])
    rng = random.Random(7)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(40):  # one group of mutually near texts, more than a block holds
        x = list(base)
        x[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(x)))
    # a copy, a null id, and two different texts under one id
    rows += [(90, rows[3][1]), (None, " ".join(base)), (91, " ".join(["y", *base])), (91, "one two three four five six"), (92, "one two three four five six")]
    sets = [{tuple(w[i:i + 4]) for i in range(len(w) - 3)} for _, t in rows for w in [t.split()]]
    want = [sum(i != j and 100 * len(a & b) >= 85 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert sum(want) > 39 * 40
    got = ngram_join.jaccard_join(texts(rows)).collect()
    assert sorted((repr(r.doc_id), r.n_links) for r in got) == sorted((repr(i), n) for (i, _), n in zip(rows, want))
    assert {r.component_id for r in got} == {0, 91}
    alone = ngram_join.jaccard_join(texts(rows), links=False)
    assert sorted(map(repr, alone.collect())) == sorted(repr(r) for r in ngram_join.jaccard_join(texts(rows)).drop("n_links").collect())


def test_dual_traversal_links_are_verified():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[i % 30:], rng.integers(0, 1 << 60, i % 30, dtype=np.uint64)])) for i in range(60)]
    ids = np.arange(60)
    links = ngram_join.dual_traversal(ngram_join.Tree(ids, sets, ids, 1024), None, 85, 100)
    jaccard = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    assert all(jaccard(a, b) >= 0.85 for a, b in links)
    assert smallest_reachable(60, links) == smallest_reachable(60, [(a, b) for a in range(60) for b in range(a) if jaccard(a, b) >= 0.85])


def test_lm_scores(texts, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_WORDS", 200)
    monkeypatch.setattr(lm_scoring, "TABLE_GRAMS", 150)
    rows = [r for r in copies(2, 12, 20)] + [(None, "w1 w2 zz"), (9, "w1 w1 w1"), (9, "w1 w1 w1")]
    words = [WORD.findall(t or "") for _, t in rows]
    grams = lambda w, n: Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    for order in (2, 3):
        total = [sum((grams(w, n) for w in words), Counter()) for n in range(1, order + 1)]
        want = []
        for (i, _), w in zip(rows, words):
            own = [grams(w, n) for n in range(1, order + 1)]
            count = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
            score = 0.0
            for j in range(len(w)):
                n, factor = min(order, j + 1), 1.0
                while n > 1 and count(tuple(w[j - n + 1:j + 1])) <= 0:
                    n, factor = n - 1, factor * 0.4
                g = tuple(w[j - n + 1:j + 1])
                score += math.log(factor * (count(g) / count(g[:-1]) if n > 1 else max(count(g), 0.5) / max(1, sum(map(len, words)) - len(w))))
            want.append((repr(i), len(w), round(score, 6)))
        got = [(repr(r.doc_id), r.n_words, round(r.log_score, 6)) for r in lm_scoring.score_documents(texts(rows), order=order).collect()]
        assert [x[:2] for x in sorted(got)] == [x[:2] for x in sorted(want)]
        assert np.allclose([x[2] for x in sorted(got)], [x[2] for x in sorted(want)], atol=1e-5)
    assert lm_scoring.score_documents(texts([])).count() == 0


def test_registered_lm_scores_use_trigrams(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["a b c"] * 3 + ["d b e"] * 3 + ["a b c", "a b e"])]  # the last two differ in trigrams only
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.log_score for r in QUERIES["op2_lm_scoring"](spark, str(tmp_path)).collect()}
    assert got[6] > got[7] + 0.5


@pytest.mark.parametrize("per_partition", [20_000, 30])
def test_packing_against_the_tokenizer(texts, monkeypatch, per_partition):
    monkeypatch.setattr(packing, "PIECES_PER_PARTITION", per_partition)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = copies(3, 40) + [(900, "it's <|endoftext|> \x01 H̱ é 日本 123 %%%!!"), (None, "one"), (901, "long " * 3000), (900, "again")]
    got = packing.pack(texts(rows), path, capacity=256).toPandas()
    tokenizer = Tokenizer.from_file(path)
    rows += [(902, "it<|endoftext|>is <|ENDOFTEXT|> <|StartOfText|> A<|startoftext|>"), (903, "plain <| words |> ABC"), (904, "é<|endoftext|>É")]
    got = packing.pack(texts(rows), path, capacity=256).toPandas()
    want = []
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(repr(i), p, s, min(256, len(ids) - s), zlib.crc32(ids[s:s + 256].tobytes())) for p, s in enumerate(range(0, len(ids), 256))]
    ids = [repr(None if i != i else int(i)) for i in got["doc_id"]]
    assert sorted(zip(ids, got["piece"], got["start"], got["length"], got["ids_crc32"])) == sorted(want)
    for _, sequence in got.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert list(sequence["offset"]) == list(np.cumsum([0, *sequence["length"][:-1]])) and sequence["length"].sum() <= 256
    bound = packing.lower_bound(np.bincount(got["length"], minlength=257), 256)
    assert bound <= got["sequence_id"].nunique() <= bound + 2
    assert packing.pack(texts([]), path).count() == 0


def test_lower_bound_is_tight_where_pairs_do_not_fit():
    counts = np.zeros(101, np.int64)
    counts[[60, 51]] = 4, 3
    assert packing.lower_bound(counts, 100) == 7  # no two fit together, though their sum fills less than five
    assert packing.best_fit_decreasing(np.array([60] * 4 + [40] * 4), 100)[0].max() == 3


INSULTS = ["zorgle", "blarfen", "quimbat", "drosk"]


def toxic_rows(seed: int, n: int) -> list[tuple[int, str, int]]:
    rng, vocabulary = random.Random(seed), ["".join(random.Random(i).choice("aeioustrnlm") for _ in range(3 + i % 6)) for i in range(800)]
    out = []
    for i in range(n):
        words, bad = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 200))], i % 5 == 0
        for _ in range(rng.randrange(3, 9) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity_on_held_out_rows(texts):
    model = fit_toxicity([(t, y) for _, t, y in toxic_rows(1, 500)])
    held = toxic_rows(2, 200) + [(1000, None, 0), (1001, "", 0), (None, "zorgle zorgle blarfen drosk", 1), (1, "plain", 0)]
    got = score_toxicity(texts([(i, t) for i, t, _ in held]), model).collect()
    assert len(got) == len(held) and all(0 <= r.score <= 1 for r in got)
    predicted = {r.doc_id: r.predicted for r in got}
    assert np.mean([predicted[i] == y for i, _, y in held[2:200]]) > 0.95
    assert predicted[1000] == predicted[1001] == 0
    assert score_toxicity(texts([]), model).count() == 0 and fit_toxicity([]).weights


def test_toxicity_of_phrases_of_ordinary_words():
    """Toxic and ordinary texts use the same short words equally often; toxic ones hold them in fixed phrases."""
    rng, vocabulary = random.Random(5), [a + b for a in "bcdfglmn" for b in ("ae", "io", "ou", "ey", "ar", "un")]
    phrases = [[rng.choice(vocabulary) for _ in range(5)] for _ in range(12)]

    def rows(n):
        out = []
        for i in range(n):
            words = [w for _ in range(15) for w in rng.choice(phrases)]
            if i % 2:
                rng.shuffle(words)
            out.append((" ".join(words), 1 - i % 2))
        return out

    model, held = fit_toxicity(rows(400)), rows(100)
    measure = toxicity.Distances(model)
    x = toxicity._inputs(np.array([measure.counts(t) for t, _ in held])) @ np.array(model.weights)
    assert np.mean((x > 0) == [y for _, y in held]) > 0.95


def test_toxicity_keeps_all_marked_words():
    rng = random.Random(6)
    marked = ["".join(rng.choice("bcdfgaeiou") for _ in range(9)) for _ in range(300)]  # more than 1,500 bytes
    rows = [(" ".join(rng.sample(marked, 150) if i % 2 else [f"plain{rng.randrange(50)}" for _ in range(150)]), i % 2) for i in range(300)]
    model = fit_toxicity(rows)
    assert all(b" " + w.encode() + b" " in model.toxic for w in marked)


def brute_links(vectors: list, cosine: float) -> list[tuple[int, int]]:
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for v, g in zip(vectors, good)]
    return [(i, j) for i in range(len(vectors)) for j in range(i) if good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine]


def test_near_vectors_recall_and_counts(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(1)
    vectors = [list(map(float, v)) for v in rng.normal(size=(150, 24)).astype("f4")]
    for i in range(60):
        vectors.append([float(np.float32(x + 0.15 * rng.normal())) for x in vectors[i % 7]])
    vectors += [vectors[3], vectors[3], None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] * 24, [1.0, 2.0], [2.0, 4.0]]
    want = brute_links(vectors, 0.95)
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 as id", "'x' as v")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    assert sum(r.n_links for r in got.values()) >= 2 * 0.99 * len(want)
    number = Counter(x for link in want for x in link)
    assert all(r.n_links <= number[i] for i, r in got.items())
    label = smallest_reachable(len(vectors), want)
    assert np.mean([got[i].component_id == label[i] for i in range(len(vectors))]) >= 0.98
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


PAGE = ('<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now.</div>'
        '<article><h1>Head &amp; tail</h1><p>First  part\nof it.<p>Second <b>part</b>.</p></article><div class="comments"><p>Nice one, I say.</p></div>'
        '<footer>&copy; 2020 somebody.</footer></body></html>')


def test_main_text(spark):
    want = "Head & tail\nFirst part of it.\nSecond part."
    broken = PAGE[:PAGE.index("</article>")]
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", broken), (4, "x", "<div>" * 3000 + "deep"), (5, "y", "<nav>menu &am")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as id", "2 as text")
    got = sorted(((repr(r.page_id), r.text, r.n_chars) for r in main_text(df).collect()))
    assert got.count(("1", want, len(want))) == 2 and ("2", "", 0) in got and ("None", "", 0) in got and ("3", want, len(want)) in got
    assert main_text(df.limit(0)).count() == 0
    assert extract([], default_model()) == []


def test_substring_dedup(texts):
    rng, n = random.Random(5), 10
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([10, 12, 15, 30]))] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "a  b")]
    for d in range(3, 60):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))]
        rows.append((d, " ".join(words)))
    rows += [(90, rows[10][1]), (91, rows[10][1]), (92, " ".join(vocabulary * 200))]
    first, want = {}, {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - n + 1):
            first[tuple(w[i:i + n])] = min(d, first.get(tuple(w[i:i + n]), d))
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i:i + n])] < d for j in range(i, i + n)}
        want[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(texts(rows), window=n).collect()}
    assert got == want
    again = substring_dedup(texts(rows + [(None, rows[10][1]), (5, rows[5][1])]), window=n, layout=True, carry=("n", "h")).collect()
    assert len(again) == len(rows) + 2 and [r.kept_text for r in again if r.doc_id is None] == [rows[10][1]]
    assert {r.kept_text for r in again if r.doc_id == 2} == {"a  b"}
    assert substring_dedup(texts([])).count() == 0


def test_fingerprints(texts):
    rows = [(i, "\n".join(f"line {i} {j} with some words of number {i * j}" for j in range(i % 9))) for i in range(40)] + [(50, None), (51, "日本語"), (52, "same"), (53, "same")]
    got = {r.doc_id: r for r in edited_fingerprints(texts(rows)).collect()}
    order = sorted((i for i, _ in rows), reverse=True)
    text = {i: t or "" for i, t in rows}
    for a, b in zip(order, order[1:] + order[:1]):
        n = len(text[a])
        edited = text[a][:n - n // 3] + text[b][:n // 3]
        assert got[a].n_chars == n and got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[a].near_next <= 1 and (got[a].near_edited == 1 or edited != text[a])
    assert got[52].fingerprint == got[53].fingerprint and len({r.fingerprint for r in got.values()}) == len(set(text.values()))
    assert np.mean([got[i].near_edited > got[i].near_next for i in range(40) if i % 9 > 2]) > 0.9
    assert edited_fingerprints(texts([])).count() == 0 and edited_fingerprints(texts([(None, "x"), (None, None), (1, "x")])).count() == 3


def test_bpe_round_trip_with_stitched_chunks(texts):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = copies(6, 10) + [(None, "abc" * 2000 + "  x" * 500), (800, "x" * 5000), (801, " " * 3000 + "a"), (802, "it's we're 日本́ " * 300), (802, "it's we're 日本́ " * 300)]
    use = {"path": path, "pattern": pattern}
    got = decode(encode(texts(rows), **use, chunk=200, overlap=40), **use).collect()
    want = sorted((repr(i), np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert sorted((repr(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert encode(texts([]), **use).count() == 0


def test_quality_on_held_out_rows(spark):
    rng = random.Random(3)

    def row(i):
        bad = i % 4 == 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 80))]
        return i, " ".join(w.upper() + "!!" if bad else w for w in words), f"host{i % 3}", "p", int(not bad)

    rows = [row(i) for i in range(400)]
    model = fit_quality([(r[1], r[4]) for r in rows[:200]])
    more = rows[200:] + [(1000, None, None, None, 1), (1001, "", "lonely", "q", 1), (None, "x", "lonely", None, 1)]
    df = spark.createDataFrame(more, "doc_id long, text string, source string, lang string, y int").selectExpr("*", "1 as host", "2 as path", "3 as p", "4 as z")
    got = score_quality(df, model, carry=("y",)).collect()
    assert len(got) == len(more) and all(0 <= r.quality <= 1 for r in got)
    assert np.mean([r.accepted == (r.y == 1) for r in got if r.doc_id is not None and r.doc_id < 1000]) > 0.97
    assert score_quality(df.limit(0), model).count() == 0


def test_main_text_of_plain_pages_forms_and_formulas():
    say = "The river rose again in the night, and by morning the lower road was closed. "
    article = lambda inner: f"<html><body><article><h1>A river</h1><p>{say * 3}</p>{inner}<p>{say * 2}</p></article></body></html>"
    model = default_model()
    plain, inline, empty = extract([f"Just text &amp; more.\n{say}", f"Some <b>bold</b> text. {say}", "<p></p>"], model)
    assert plain == f"Just text & more. {say}".strip() and inline == f"Some bold text. {say}".strip() and empty == ""
    form, area, formula, framed = extract([
        article("<form><p>Type here and press enter.</p></form>"), article("<p>Before <textarea>x y</textarea><button>Go</button> after.</p>"),
        article("<p>So <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>a+b</annotation></math> holds.</p>"),
        f"<html><body><form action='/'><nav><a href='/'>Home</a></nav><article><h1>A river</h1><p>{say * 4}</p></article></form></body></html>"], model)
    assert "Type" not in form and form.count("river rose") == 5
    assert "x y" not in area and "Go" not in area and "Before after." in area
    assert "So a+b holds." in formula and "Home" not in framed and framed.startswith("A river")


def test_sum_product_against_enumeration():
    from itertools import product

    from gaugewell.llm.html_extract import sum_product

    rng = np.random.default_rng(3)
    for parent in ([-1], [-1, 0, 0, 1, 1, 4], [-1, 0, 1, 2, -1, 4, 4], [-1, -1, 0, 1, 1]):
        own, joint, n = rng.normal(size=len(parent)) * 2, rng.normal(size=(2, 2)), len(parent)
        weights = {y: np.exp(sum(o for o, v in zip(own, y) if v) + sum(joint[y[q], v] for q, v in zip(parent, y) if q >= 0)) for y in product((0, 1), repeat=n)}
        total = sum(weights.values())
        p, pair = sum_product(own, np.array(parent), joint)
        assert np.allclose(p, [sum(w for y, w in weights.items() if y[i]) / total for i in range(n)])
        children = [i for i in range(n) if parent[i] >= 0]
        for i, found in zip(children, pair):
            assert np.allclose(found, [[sum(w for y, w in weights.items() if (y[parent[i]], y[i]) == (a, b)) / total for b in (0, 1)] for a in (0, 1)])


def test_ngrams_travel_as_compressed_steps():
    hashes = np.sort(np.random.default_rng(5).integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2))
    packed = lm_scoring._pack(hashes)
    assert np.array_equal(lm_scoring._unpack(packed), hashes >> np.uint64(64 - lm_scoring.KEPT_BITS)) and len(packed) < 4 * len(hashes)
    totals = np.array([1, 1, 2, 70_000, 1 << 40], np.int64)
    assert np.array_equal(lm_scoring._expand(lm_scoring._squeeze(totals, 8), 8), totals)
    assert len(lm_scoring._squeeze(np.tile(totals[:3], 10_000), 4)) < 1_000


def test_wide_signatures_are_compared_a_few_at_a_time(monkeypatch):
    bits = np.random.default_rng(2).integers(0, 1 << 63, (50, 512), dtype=np.uint64)
    a, b = np.repeat(np.arange(50), 50), np.tile(np.arange(50), 50)
    seen, count = [], np.bitwise_count
    want = count(bits[a] & bits[b]).sum(1, dtype=np.int64)
    monkeypatch.setattr(ngram_join, "COMPARED_BYTES", 1 << 16)
    monkeypatch.setattr(ngram_join.np, "bitwise_count", lambda x: seen.append(x.nbytes) or count(x))
    assert np.array_equal(ngram_join._common_bits(bits, bits, a, b), want) and max(seen) <= 1 << 16
