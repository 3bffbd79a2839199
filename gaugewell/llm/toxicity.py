"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window.

Two dictionaries are trained (zstandard's COVER) on labelled toxic and ordinary texts. A text is cut into overlapping windows of WINDOW
words of any length, and each window is compressed with both; its distance is how many bytes fewer the toxic dictionary needs.

Single words are compared as well. Two more dictionaries start with the same common words of ordinary text; one ends in the words
that labelled toxic documents use more than ordinary ones, the other in as many bytes of the ordinary words that the first end would
shorten most. The distance of a word between fixed ordinary passages is how many bytes fewer the toxic end needs, for each byte of the
word, averaged over passages of two lengths.

The numbers of windows and of words above each of a grid of distances are calibrated into a probability by logistic regression on
labelled documents that gave nothing to the dictionaries.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.classifier import fit_logistic
from gaugewell.llm.shared import bounded_batches

GRID = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)
COMMON_BYTES, END_BYTES, LEAST_EVIDENCE, SHORTEST = 48_000, 3_000, 20.0, 4
WINDOW, STEP, SAVED, TRAINED_BYTES = 10, 6, tuple(range(-1, 7)), 100_000
CACHE_WORDS = 250_000
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_LETTERS).split()


@dataclass(frozen=True)
class Model:
    """Two dictionaries of words (common part, marked ends), two trained ones, and the weights that turn counts into a probability."""

    common: bytes
    toxic: bytes
    ordinary: bytes
    trained: tuple[bytes, bytes]  # of ordinary and of toxic text
    weights: tuple[float, ...]


def windows_of(words: list[bytes]) -> list[bytes]:
    """Overlapping windows that cover all words; a shorter text is one window."""
    last = max(0, len(words) - WINDOW)
    return [b" ".join(words[i:i + WINDOW]) + b" " for i in [*range(0, last, STEP), last]] if words else []


def train(texts: list[str | None]) -> bytes:
    """A dictionary trained on the texts; the texts themselves where they are too few or too small to train on."""
    samples = [x for x in (b" ".join(words_of(t)) for t in texts) if x]
    try:
        return zstandard.train_dictionary(TRAINED_BYTES, samples, k=24, d=6, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" " + b" ".join(samples)[-TRAINED_BYTES:]


class Distances:
    """Distances of windows, and of words as classes (number of grid values reached), remembered for up to CACHE_WORDS words."""

    def __init__(self, model: Model):
        self.front = model.common[-40:] + b" "
        self.backs = (b" then the and of ", b" then the and of the in is ")
        self.pairs = [self._compressor(model.common + end) for end in (model.ordinary, model.toxic)]
        self.matches = {model.toxic[i:i + 4] for i in range(len(model.toxic) - 3)}
        self.known: dict[bytes, int] = {}
        self.windows = [self._trained(content) for content in model.trained]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(
            5, min_match=4, strategy=zstandard.STRATEGY_BTOPT, window_log=max(17, len(content).bit_length()), write_content_size=False, write_checksum=False, write_dict_id=False)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)

    @staticmethod
    def _trained(content: bytes) -> zstandard.ZstdCompressor:
        dictionary = zstandard.ZstdCompressionDict(content)
        settings = zstandard.ZstdCompressionParameters.from_level(
            3, min_match=4, strategy=zstandard.STRATEGY_GREEDY, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
        dictionary.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)

    def saved(self, words: list[bytes]) -> np.ndarray:
        """Bytes that the trained toxic dictionary saves in each window."""
        ordinary, toxic = ([len(x) for x in map(c.compress, windows_of(words))] for c in self.windows)
        return np.array(ordinary, np.int64) - np.array(toxic, np.int64)

    def measure(self, word: bytes) -> int:
        shown = b" " + word + b" "
        if len(word) < SHORTEST or not any(shown[i:i + 4] in self.matches for i in range(len(shown) - 3)):
            return 0  # the toxic dictionary has no match of the least length to offer
        ordinary, toxic = self.pairs
        saved = sum(len(ordinary.compress(x)) - len(toxic.compress(x)) for x in (self.front + word + back for back in self.backs))
        return sum(saved / (len(self.backs) * (len(word) + 1)) >= g for g in GRID)

    def counts(self, text: str | None) -> np.ndarray:
        """Words that reach each grid value, all words, windows that reach each value of SAVED, and all windows."""
        words = words_of(text)
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.measure(w)
        reached = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=len(GRID) + 1)
        saved = self.saved(words)
        above = [np.count_nonzero(saved >= g) for g in SAVED]
        return np.array([*np.cumsum(reached[:0:-1])[::-1], len(words), *above, len(saved)], float)


def _inputs(counts: np.ndarray) -> np.ndarray:
    marked, words, saved, windows = np.split(counts, [len(GRID), len(GRID) + 1, len(GRID) + 1 + len(SAVED)], axis=1)
    shares = [np.log1p(marked), np.log((marked + 0.3) / (words + 30)), np.log1p(saved), np.log((saved + 0.3) / (windows + 30))]
    return np.column_stack([*shares, np.log1p(words), np.ones(len(counts))])


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """Fits from (text, label) rows: one half gives the dictionaries, the other calibrates. Repeated texts count once."""
    rows = list(dict.fromkeys((t, int(label)) for t, label in rows))
    kinds = [[t for t, label in rows if label == k] for k in (0, 1)]
    number, held = [0, 0], [Counter(), Counter()]
    for k in (0, 1):
        for t in kinds[k][::2]:
            held[k].update(set(words_of(t)))
            number[k] += 1
    marks = []
    for w, n in held[1].items():
        ratio = ((n + 0.05) / (number[1] + 0.1)) / ((held[0][w] + 0.05) / (number[0] + 0.1))
        if ratio > 3 and n * math.log(ratio) > LEAST_EVIDENCE and len(w) >= SHORTEST:
            marks.append((n * math.log(ratio), w))
    marked, size = [], 0
    for _, w in sorted(marks, reverse=True):
        marked.append(w)
        size += len(w) + 1
    end = max(END_BYTES, 2 * size)  # all marked words, and at least as much filler
    trained = train(kinds[0][::2]), train(kinds[1][::2])
    common = b" ".join(w for w, _ in sorted(held[0].items(), key=lambda x: (x[1], x[0])))
    filler, common = common[:-COMMON_BYTES][-end:].rjust(end), common[-COMMON_BYTES:] or b" "
    toxic = (filler + b" " + b" ".join(reversed(marked)) + b" ")[-end:]
    # ordinary words that the toxic end would shorten most go to the ordinary end
    measure = Distances(Model(common, toxic, filler, trained, ()))
    confused = sorted(((n * d, w) for w, n in held[0].items() if n > 1 and (d := measure.measure(w))), reverse=True)
    chosen, size = [], 0
    for _, w in confused:
        chosen.append(w)
        size += len(w) + 1
        if size > end:
            break
    model = Model(common, toxic, (filler + b" " + b" ".join(reversed(chosen)) + b" ")[-end:], trained, ())
    measure, rest = Distances(model), [(t, k) for k in (0, 1) for t in kinds[k][1::2] or kinds[k]]
    if not rest:
        return replace(model, weights=(0.0,) * (2 * len(GRID) + 2 * len(SAVED) + 2))
    counts = np.array([measure.counts(t) for t, _ in rest])
    return replace(model, weights=tuple(fit_logistic(_inputs(counts), np.array([k for _, k in rest], float))))


_KEPT: dict[str, object] = {}  # the last model's distances, so that the words a worker knows outlive its task


def _distances(model: Model) -> Distances:
    if _KEPT.get("model") != model:
        _KEPT.update(model=model, measure=Distances(model))
    return _KEPT["measure"]


def _score(batches: Iterator[pa.RecordBatch], model: Model, keep_text: bool) -> Iterator[pa.RecordBatch]:
    measure = _distances(model)
    for batch in batches:
        at = batch.schema.get_field_index("text")
        counts = np.array([measure.counts(t.as_py()) for t in batch.column(at)]).reshape(-1, len(GRID) + len(SAVED) + 2)
        p = 1 / (1 + np.exp(-np.clip(_inputs(counts) @ np.array(model.weights), -30, 30)))
        kept = [i for i, c in enumerate(batch.schema.names) if keep_text or i != at]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(p, pa.float64())], names=[*[batch.schema.names[i] for i in kept], "score"])


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7,
                   carry: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """One row per input row: id, score (0 to 1), predicted (1 from the threshold on), the columns named in carry, and with keep_text the text.

    A null text counts as empty and, like a text without words, scores by the calibration of a document without windows. Rows
    with null or repeated ids are scored like any other. Other columns are ignored. An empty table gives an empty result.
    """
    names = [f"c{i}" for i in range(len(carry))]
    source = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(n) for c, n in zip(carry, names)])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if keep_text or f.name != "text") + ", score double"
    scored = source.mapInArrow(partial(_score, model=model, keep_text=keep_text), kinds)
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                         *[F.col(n).alias(c) for n, c in zip(names, carry)], *[F.col("text").alias(text_col)] * keep_text)
