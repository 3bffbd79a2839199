"""Stupid-backoff language-model scores from the counts of the corpus itself.

Documents are dealt to blocks by hash. A block explodes its texts into n-grams of 1 to `order` words, counts its distinct ones and
sends them, as compressed steps between sorted hashes, to count tables that are partitioned by n-gram hash. A partition sums the counts of all blocks and joins them back
to each block's n-grams. The block then scores every word of its documents and sums per document. A document's own n-grams are
taken out of the counts it is scored by, so a text is not likely merely because it is in the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.hashing import documents_words, sequence_hashes, slice_words
from gaugewell.llm.shared import bounded_batches

BLOCK_WORDS, TABLE_GRAMS = 600_000, 2_000_000
KEPT_BITS = 40  # of a hash, besides those that name its partition


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = sum(len(h) for _, h, _ in slice_words(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([words], pa.int64())], names=["words"])


def _grams(texts: pd.Series, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to order: hashes of the n-grams of all texts in turn, and where each text's begin and the last one's end."""
    words = [w for _, w in documents_words(pa.array(texts, pa.string()))]
    out = []
    for n in range(1, order + 1):
        found = [sequence_hashes(w, n, 0x9FB21C651E98DF25 + 2 * n) for w in words]
        out.append((np.concatenate([*found, np.zeros(0, np.uint64)]), np.cumsum([0] + [len(f) for f in found])))
    return out


def _squeeze(values: np.ndarray, width: int) -> bytes:
    """Whole numbers below 256**width: their lowest bytes, then the next ones and so on, compressed."""
    return zstandard.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def _expand(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _pack(hashes: np.ndarray) -> bytes:
    """The KEPT_BITS highest bits of each of the ascending hashes, as steps; the partition number is taken from the lowest."""
    return _squeeze(np.diff(hashes >> np.uint64(64 - KEPT_BITS), prepend=np.uint64(0)), KEPT_BITS // 8)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_expand(data, KEPT_BITS // 8), dtype=np.uint64)


def _split(hashes: np.ndarray, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes in the order of their tables, number of each hash in them, counts, where each table begins and the last ends)."""
    distinct, number, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    table = (distinct % np.uint64(tables)).astype(np.int64)
    order = np.argsort(table, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[number], counts[order], np.searchsorted(table[order], np.arange(tables + 1))


def _ask(pdf: pd.DataFrame, order: int, tables: int) -> pd.DataFrame:
    rows = []
    for n, (hashes, _) in enumerate(_grams(pdf["text"], order), 1):
        distinct, _, counts, begins = _split(hashes, tables)
        rows += [(n, t, int(pdf["block"].iloc[0]), _pack(distinct[a:b]), _squeeze(counts[a:b], 4))
                 for t, (a, b) in enumerate(zip(begins[:-1], begins[1:])) if b > a]
    return pd.DataFrame(rows, columns=["n", "part", "block", "grams", "counts"])


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """One partition of the count table of an order, joined back to the n-grams of each block."""
    grams = [_unpack(g) for g in pdf["grams"]]
    counts = np.concatenate([_expand(c, 4) for c in pdf["counts"]])
    _, number = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(number, counts).astype(np.int64)[number]
    ends = np.cumsum([len(g) for g in grams])
    # totals of the corpus fit 32 bits unless an n-gram occurs four thousand million times
    wide = bool(total.max() >= 1 << 32)
    return pd.DataFrame({"n": pdf["n"], "part": pdf["part"], "block": pdf["block"], "totals": [_squeeze(t, 8 if wide else 4) for t in np.split(total, ends[:-1])],
                         "wide": wide})


def _score(docs: pd.DataFrame, answers: pd.DataFrame, order: int, tables: int, words: int, discount: float) -> pd.DataFrame:
    found = {(n, p): _expand(t, 8 if w else 4).view(np.int64) for n, p, t, w in zip(answers["n"], answers["part"], answers["totals"], answers["wide"])}
    all_counts, all_begins = [], []
    for n, (hashes, begins) in enumerate(_grams(docs["text"], order), 1):
        distinct, number, _, table_begins = _split(hashes, tables)
        total = np.concatenate([*(found[n, t] for t in range(tables) if table_begins[t + 1] > table_begins[t]), np.zeros(0, np.int64)])
        counts = total[number] if len(number) else np.zeros(0, np.int64)
        for a, b in zip(begins[:-1], begins[1:]):  # without the document's own
            _, inside, own = np.unique(number[a:b], return_inverse=True, return_counts=True)
            counts[a:b] -= own[inside]
        all_counts.append(counts)
        all_begins.append(begins)
    rows = []
    for d in range(len(docs)):
        of = [c[b[d]:b[d + 1]] for c, b in zip(all_counts, all_begins)]
        length = len(of[0])
        rest = max(1, words - length)
        score = np.log(np.maximum(of[0], 0.5) / rest)  # a word of this document only counts half
        for n in range(2, order + 1):
            score += np.log(discount)
            if len(of[n - 1]):
                above, context = of[n - 1], of[n - 2][:len(of[n - 1])]
                seen = above > 0
                score[n - 1:][seen] = np.log(above[seen] / context[seen])
            if length:
                score[:n - 1] -= np.log(discount)  # the first words have no such context and were not backed off
        rows.append((length, float(score.sum())))
    return pd.DataFrame({"id": docs["id"], "n_words": [r[0] for r in rows], "log_score": [r[1] for r in rows]})


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, discount: float = 0.4) -> DataFrame:
    """One row per input row: id, n_words, log_score (natural, summed over words), mean_log_score (null without words).

    The score of a word is count(its n-gram) / count(its context) for the longest n-gram up to `order` that other documents hold, times
    `discount` for each shorter step; a word that no other document holds counts half. Words are runs of characters other than space and
    0x09-0x0D. Null texts are empty and score 0. Rows with null or repeated ids are documents of their own. N-grams are told apart by
    the remainder by the number of tables and 40 further bits of their hash. Other columns are ignored. An empty table gives an empty result.
    """
    source = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = source.select("text").mapInArrow(_sizes, "words long").agg(F.sum("words")).first()[0] or 0
    blocks, tables = max(1, -(-words // BLOCK_WORDS)), max(1, -(-words // TABLE_GRAMS))
    dealt = source.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    asked = dealt.groupBy("block").applyInPandas(partial(_ask, order=order, tables=tables), "n int, part int, block long, grams binary, counts binary")
    answered = asked.groupBy("n", "part").applyInPandas(_answer, "n int, part int, block long, totals binary, wide boolean")
    scored = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(
        partial(_score, order=order, tables=tables, words=words, discount=discount), "id long, n_words long, log_score double")
    return scored.select(F.col("id").alias(id_col), "n_words", "log_score", F.try_divide("log_score", "n_words").alias("mean_log_score"))
