"""Removal of passages that already stand in a document with a smaller id, found through a count-min prefilter.

A window is `window` consecutive words. First pass: every partition sketches its windows, each under the smallest hash of its
8-word runs, so that neighbouring windows share a cell; partition sketches are sparse rows (row, cell, count) and merge by sum.
Every document that holds a window has counted that window's cell, so the estimate is never below the true count of documents.
Second pass: only windows whose cells hold two or more in each row of the sketch are grouped exactly, by 96 bits of their whole
word sequence, and give the smallest id that holds them. Windows of one count anywhere cannot repeat, so none is lost.

Copies of a whole text are settled by a digest of the text before the second pass, so a group of copies costs one document there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.hashing import documents_words, sequence_hashes, slice_words
from gaugewell.llm.shared import bounded_batches

ANCHOR_WORDS = 8
NO_ID = -(1 << 63)  # stands for a null id
CELLS = 1 << 40  # of each sketch row; cells are kept only where touched, so the width costs nothing


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each stretch of `width` values."""
    done, out = 1, x
    while 2 * done <= width:
        out, done = np.minimum(out[:-done], out[done:]), 2 * done
    return np.minimum(out[:len(x) - width + 1], out[width - done:]) if width > done else out


def _anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows with the same anchor: (id, h, anchor, start, length, first of this anchor in the document)."""
    k = min(ANCHOR_WORDS, window)
    for batch in batches:
        for first, words, at in slice_words(batch.column(2)):
            if len(words) < window:
                continue
            anchor = _least(sequence_hashes(words, k), window - k + 1)
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            inside = row[:len(anchor)] == row[window - 1:]
            where = np.flatnonzero(inside)
            if not len(where):
                continue
            anchor, row = anchor[where], row[where]
            new = np.ones(len(where), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
            begins = np.flatnonzero(new)
            length = np.diff(np.append(begins, len(where)))
            row, start, anchor = row[begins], where[begins] - at[row[begins]], anchor[begins]
            order = np.lexsort((start, anchor, row))
            once = np.ones(len(order), bool)
            once[1:] = (row[order][1:] != row[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
            counts = np.zeros(len(order), np.int32)
            counts[order] = once
            take = pa.array(row + first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(anchor.view(np.int64)), pa.array(start.astype(np.int32)),
                 pa.array(length.astype(np.int32)), pa.array(counts)], names=["id", "h", "anchor", "start", "length", "once"])


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Exact hashes of the windows in the spans of each document."""
    for batch in batches:
        spans = batch.column(3)
        for i, words in documents_words(batch.column(2)):
            begins = np.array([(s["start"], s["length"]) for s in spans[i].as_py()], np.int64).reshape(-1, 2)
            starts = np.concatenate([np.arange(s, s + n) for s, n in begins])
            one = sequence_hashes(words, window)[starts].view(np.int64)
            two = (sequence_hashes(words, window, 0xA0761D6478BD642F)[starts] >> np.uint64(33)).astype(np.int32)
            same = pa.array(np.full(len(starts), i))
            yield pa.RecordBatch.from_arrays(
                [pa.array(one), pa.array(two), batch.column(0).take(same), batch.column(1).take(same), pa.array(starts.astype(np.int32))],
                names=["w1", "w2", "id", "h", "start"])


def _remove(batches: Iterator[pa.RecordBatch], window: int, layout: bool) -> Iterator[pa.RecordBatch]:
    """Words outside the marked windows, joined by one space; with layout, a text that loses nothing as it is."""
    for batch in batches:
        texts, marks, copies = batch.column(1), batch.column(2), batch.column(3)
        rows, size = [], 0
        for i in range(len(batch)):
            words = (texts[i].as_py() or "").encode().split()
            starts = marks[i].values.to_numpy() if marks[i].is_valid else np.zeros(0, np.int64)
            kept = words
            if copies[i].as_py() and len(words) >= window:
                kept = []
            elif len(starts):
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, starts, 1)
                np.add.at(steps, starts + window, -1)
                kept = list(compress(words, np.cumsum(steps)[:-1] == 0))
            same = layout and len(kept) == len(words)
            rows.append((i, len(words), len(words) - len(kept), texts[i].as_py() if same else b" ".join(kept).decode()))
            size += len(rows[-1][3])
            if size > 1 << 22 or i == len(batch) - 1:
                at, n, removed, text = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(text, pa.string())] +
                    [batch.column(c).take(pa.array(at)) for c in range(4, batch.num_columns)],
                    names=["id", "n_words", "n_removed", "kept_text", *batch.schema.names[4:]])
                rows, size = [], 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, carry: tuple[str, ...] = (),
                    layout: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_text, and the columns named in carry. kept_text joins the kept
    words by one space; with layout, texts that lose nothing stay as they are.

    A word (run of characters other than space and 0x09-0x0D) is removed if a window that covers it also starts in a document
    with a smaller id; windows are judged on the input. Null texts are empty; texts shorter than a window keep every word. A null
    id is never smaller than another and loses nothing. Rows that repeat an id count as one document: its windows are not
    removed on account of each other. Columns outside carry are ignored, and their names may be anything. An empty table gives
    an empty result.
    """
    # the key of a text is never null: then both joins with the texts have the same input, and Spark shuffles the texts once
    names = [f"c{i}" for i in range(len(carry))]
    source = bounded_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                         *[F.col(c).alias(n) for c, n in zip(carry, names)])
    source = source.withColumn("h", F.coalesce(F.xxhash64("text"), F.lit(0)))
    known = source.where(f"id <> {NO_ID}")
    # pass 1: sparse count-min sketch with two rows of cells
    runs = known.select("id", "h", "text").mapInArrow(partial(_anchors, window=window), "id long, h long, anchor long, start int, length int, once int")
    cell = [F.expr(f"shiftrightunsigned(anchor, 24) % {CELLS}"), F.expr(f"shiftrightunsigned(xxhash64(anchor), 24) % {CELLS}")]
    cells = runs.where("once = 1").select(F.explode(F.array(*[F.struct(F.lit(j).alias("row"), c.alias("cell")) for j, c in enumerate(cell)])).alias("x"))
    sketch = cells.groupBy("x.row", "x.cell").agg(F.count("*").alias("estimate")).where("estimate >= 2")
    spans = runs.withColumn("cell", cell[0]).join(sketch.where("row = 0").select("cell"), "cell", "left_semi")
    spans = spans.withColumn("cell", cell[1]).join(sketch.where("row = 1").select("cell"), "cell", "left_semi")
    spans = spans.groupBy("id", "h").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    # copies of a whole text: all but the smallest id lose everything
    digests = known.select("id", "h", F.md5("text").alias("digest"))
    least = digests.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    copies = digests.join(least, "digest").where("id > least").select("id", "h", F.lit(True).alias("copy")).distinct()
    # pass 2: exact groups
    text_of = source.join(spans.join(copies, ["id", "h"], "left_anti").hint("shuffle_hash"), ["id", "h"])
    windows = text_of.select("id", "h", "text", "spans", *names).mapInArrow(partial(_windows, window=window), "w1 long, w2 int, id long, h long, start int")
    first = windows.groupBy("w1", "w2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    marks = windows.join(first, ["w1", "w2"]).where("id > first").groupBy("id", "h").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    settled = marks.join(copies, ["id", "h"], "full")
    out = source.join(settled.hint("shuffle_hash"), ["id", "h"], "left")
    out = out.select("id", "text", "starts", "copy", *names)
    kinds = ", ".join(["id long, n_words long, n_removed long, kept_text string", *(f"{c} {out.schema[c].dataType.simpleString()}" for c in names)])
    out = out.mapInArrow(partial(_remove, window=window, layout=layout), kinds)
    return out.select(F.nullif("id", F.lit(NO_ID)).alias(id_col), "n_words", "n_removed", "kept_text", *[F.col(n).alias(c) for n, c in zip(names, carry)])
