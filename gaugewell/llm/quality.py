"""Quality by hierarchical empirical Bayes: a document's own evidence on top of what its path and its host lead one to expect.

A logistic classifier on counts of kinds of characters and words gives each document a probability and, less the prior, a weight of
evidence. Grouped sums of the probabilities make beta posteriors: a host shrinks toward the global mean, a path toward its host. The
prior strengths come from the spread between hosts, and between the paths of a host, by the method of moments. A document's
quality adds its evidence to the log odds of its path, from which its own share is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.classifier import fit_logistic
from gaugewell.llm.hashing import as_bytes, slices, word_hashes, word_spans
from gaugewell.llm.shared import bounded_batches, cut, small

_KINDS = np.full(256, 7, np.int64)  # other bytes of longer characters
_KINDS[:128] = 6  # symbols
_KINDS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_KINDS[[9, 11, 12, 13, 32]], _KINDS[10] = 3, 5
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58] = 0, 1, 2
KINDS = 8


def measures(texts: pa.Array) -> np.ndarray:
    """Per text: log length, shares of kinds of bytes, words per byte, share of distinct words, share of words ending in a symbol or capital."""
    out = []
    for first, last in slices(texts):
        data, ends = as_bytes(texts.slice(first, last - first))
        kinds = _KINDS[data]
        starts, stops = word_spans(data, ends)
        hashes, at = word_hashes(data, starts, stops), np.searchsorted(starts, ends)
        tail = np.isin(kinds[stops - 1], (1, 6)) if len(stops) else np.zeros(0, bool)
        for i in range(last - first):
            n, words = int(ends[i + 1] - ends[i]), int(at[i + 1] - at[i])
            counts = np.bincount(kinds[ends[i]:ends[i + 1]], minlength=KINDS)
            out.append([math.log1p(n), *np.sqrt(counts / max(n, 1)), words / max(n, 1), len(np.unique(hashes[at[i]:at[i + 1]])) / max(words, 1),
                        tail[at[i]:at[i + 1]].mean() if words else 0.0, 1.0])
    return np.array(out).reshape(-1, KINDS + 5)


def fit(rows: list[tuple[str | None, int]]) -> tuple[tuple[float, ...], float]:
    """(weights, prior log odds) from (text, label) rows; label 1 is good. The prior is that of balanced classes: the sample's own odds."""
    if not rows:
        return (0.0,) * (KINDS + 5), 0.0
    y = np.array([label for _, label in rows], float)
    weights = fit_logistic(measures(pa.array([t for t, _ in rows], pa.string())), y, 1.0)
    return tuple(weights), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))


def _probability(batches: Iterator[pa.RecordBatch], weights: tuple[float, ...], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        z = np.clip(measures(batch.column(batch.schema.get_field_index("text"))) @ np.array(weights), -30, 30)
        kept = [c for c in batch.schema.names if keep_text or c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(z)], names=[*kept, "z"])


def _strength(groups: DataFrame, parent: str) -> float:
    """Strength of the beta prior (in documents) of groups (n, s, and the mean of their parent) by the method of moments, 1 to 10,000."""
    row = groups.where("n > 1").agg(
        F.sum(F.expr(f"n * pow(s / n - {parent}, 2)")).alias("between"), F.sum(F.expr(f"{parent} * (1 - {parent})")).alias("noise"),
        F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.expr(f"n * {parent} * (1 - {parent})")).alias("spread")).first()
    if not row["groups"] or row["between"] <= row["noise"]:
        return 10_000.0
    share = (row["between"] - row["noise"]) / max(row["spread"] - row["noise"], 1e-9)
    return float(min(10_000.0, max(1.0, 1 / max(share, 1e-9) - 1)))


def score_quality(docs: DataFrame, model: tuple[tuple[float, ...], float], id_col: str = "doc_id", text_col: str = "text", host: str = "source",
                  path: str = "lang", threshold: float = 0.5, carry: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """One row per input row: id, evidence, host_quality, path_quality, quality (0 to 1), accepted (quality >= threshold), carry, and with
    keep_text the text.

    host and path name columns; a path is counted within its host, and null is a host or path of its own. A null text is an empty one.
    Rows with null or repeated ids are scored like any other. Other columns are ignored. An empty table gives an empty result.
    """
    weights, prior = model
    names = [f"c{i}" for i in range(len(carry))]
    source = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                         F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), *[F.col(c).alias(n) for c, n in zip(carry, names)])
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if keep_text or f.name != "text") + ", z double"
    scored = source.mapInArrow(partial(_probability, weights=weights, keep_text=keep_text), shape)
    scored = scored.withColumn("evidence", F.col("z") - F.lit(prior)).withColumn("p", F.expr("1 / (1 + exp(-z))"))
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    paths = cut(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = (total[1] + 1) / (total[0] + 2) if total[0] else 0.5
    strength = _strength(hosts.withColumn("mean", F.lit(mean)), "mean")
    hosts = hosts.select("host", ((F.col("s") + strength * mean) / (F.col("n") + strength)).alias("host_quality"))
    table = cut(paths.join(hosts, "host"))
    inner = _strength(table, "host_quality")
    out = scored.join(small(table), ["host", "path"])
    alone = (F.col("s") - F.col("p") + inner * F.col("host_quality")) / (F.col("n") - 1 + inner)
    alone = F.least(F.greatest(alone, F.lit(1e-6)), F.lit(1 - 1e-6))
    quality = 1 / (1 + F.exp(-(F.col("evidence") + F.log(alone / (1 - alone)))))
    return out.select(F.col("id").alias(id_col), "evidence", "host_quality", alone.alias("path_quality"), quality.alias("quality"),
                      (quality >= threshold).alias("accepted"), *[F.col(n).alias(c) for n, c in zip(names, carry)], *[F.col("text").alias(text_col)] * keep_text)
