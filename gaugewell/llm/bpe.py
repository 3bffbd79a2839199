"""Byte-level BPE encoding of whole texts in overlapping chunks, and decoding by concatenating the bytes of the ids.

A text longer than a chunk is cut into chunks that overlap. Chunks are pre-tokenised in parallel, each from its first character,
which may lie inside a pre-token. Matching depends only on what follows, so from the first boundary in the overlap that both
neighbours have, the later chunk agrees with the whole text; there they are stitched. The pieces between the stitches are then
encoded in parallel and joined per document. A text whose neighbours share no boundary in some overlap is encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.shared import bounded_batches, cut

CHUNK_CHARS, OVERLAP_CHARS, LOOK_AHEAD = 65_536, 512, 4
CACHE_PIECES, BATCH_BYTES = 300_000, 8 << 20


class Codec:
    """Encodes pre-tokens by rank, remembering those seen lately; decodes ids by a table of bytes."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pattern, self.known = regex.compile(pattern), {}

    def encode(self, pieces: list[str]) -> bytes:
        """Little-endian unsigned 32-bit ids of pre-tokens."""
        if len(self.known) > CACHE_PIECES:
            self.known = {}
        known = self.known
        for piece in set(pieces).difference(known):
            known[piece] = np.array(self.encoding.encode_ordinary(piece), "<u4").tobytes()
        return b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def bounds(self, text: str) -> np.ndarray:
        return np.fromiter((m.end() for m in self.pattern.finditer(text)), np.int64)


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _batched(batch: pa.RecordBatch, drop: str, name: str, kind: pa.DataType, values: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """The batch with a column replaced by new values, in parts of bounded size."""
    kept = [c for c in batch.schema.names if c != drop]
    first, held, size = 0, [], 0
    for value in values:
        held.append(value)
        size += len(value)
        if size > BATCH_BYTES or first + len(held) == len(batch):
            part = batch.slice(first, len(held))
            yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], pa.array(held, kind)], names=[*kept, name])
            first, held, size = first + len(held), [], 0


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(path, pattern)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        yield from _batched(batch, "text", "ids", pa.binary(), (codec.encode(codec.pattern.findall(t.as_py() or "")) for t in texts))


def _decode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(path, pattern)
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("ids"))
        yield from _batched(batch, "", "decoded", pa.binary(), (codec.decode(x.as_py() or b"") for x in ids))


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Chunks with their overlap: (id, h, chunk, last, text), where text starts at character number * chunk."""
    for batch in batches:
        for i in range(len(batch)):
            text = batch.column(2)[i].as_py()
            number = -(-len(text) // chunk)
            for k in range(number):
                part = text[k * chunk:(k + 1) * chunk + overlap]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([k], pa.int32()), pa.array([k == number - 1]), pa.array([part])],
                    names=["id", "h", "chunk", "last", "text"])


def _edges(batches: Iterator[pa.RecordBatch], path: str, pattern: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Boundaries at the start of each chunk and those it is sure of in its overlap, both from the place where the next chunk begins."""
    codec = _codec(path, pattern)
    for batch in batches:
        heads, tails = [], []
        for text in batch.column(4).to_pylist():
            at = np.concatenate([[0], codec.bounds(text)])
            heads.append(at[at <= overlap])
            tails.append(at[(at >= chunk) & (at <= len(text) - LOOK_AHEAD)] - chunk)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                                         names=["id", "h", "chunk", "last", "head", "tail"])


def _encode_stitched(batches: Iterator[pa.RecordBatch], path: str, pattern: str, chunk: int) -> Iterator[pa.RecordBatch]:
    codec = _codec(path, pattern)
    for batch in batches:
        texts, begins, ends = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "begin", "end"))
        cut_texts = (t.as_py()[b.as_py():(chunk + e.as_py() if e.is_valid else None)] for t, b, e in zip(texts, begins, ends))
        yield from _batched(batch, "text", "ids", pa.binary(), (codec.encode(codec.pattern.findall(t)) for t in cut_texts))


def _join(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    return pd.DataFrame({"id": pdf["id"].iloc[:1], "h": pdf["h"].iloc[:1], "ids": [b"".join(pdf["ids"])]})


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS,
           overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per input row: id and ids, the bytes of little-endian unsigned 32-bit token ids, as the tiktoken library gives them.

    Null and empty texts have no ids. Rows with null ids and repeated rows are encoded like any other. Other columns are ignored. An
    empty table gives an empty result.
    """
    use = {"path": path, "pattern": pattern}
    source = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    short = source.where(F.char_length("text") <= chunk).mapInArrow(partial(_encode, **use), "id long, ids binary")
    long = source.where(F.char_length("text") > chunk).groupBy("id", F.xxhash64("text").alias("h"), "text").agg(F.count("*").alias("copies"))
    chunks = long.select("id", "h", "text").mapInArrow(partial(_chunks, chunk=chunk, overlap=overlap), "id long, h long, chunk int, last boolean, text string").repartition("id", "h", "chunk")
    edges = cut(chunks.mapInArrow(partial(_edges, **use, chunk=chunk, overlap=overlap), "id long, h long, chunk int, last boolean, head array<long>, tail array<long>"))
    before = edges.select(F.col("id").alias("id_"), F.col("h").alias("h_"), (F.col("chunk") + 1).alias("chunk_"), "tail").where("not last")
    met = edges.drop("tail").join(before, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")) & (F.col("chunk") == F.col("chunk_")), "left")
    begins = met.select("id", "h", "chunk", F.when(F.col("chunk") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("head", "tail"))).alias("begin"))
    whole = begins.groupBy("id", "h").agg(F.count_if(F.col("begin").isNull()).alias("lost"), F.count("*").alias("chunks"))
    ends = begins.where("chunk > 0").select(F.col("id").alias("id_"), F.col("h").alias("h_"), (F.col("chunk") - 1).alias("chunk_"), F.col("begin").alias("end"))
    spans = cut(begins.join(ends, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")) & (F.col("chunk") == F.col("chunk_")), "left")
                .select("id", "h", "chunk", "begin", "end"))
    whole = cut(whole)
    good = whole.where("lost = 0").select(F.col("id").alias("id_"), F.col("h").alias("h_"))
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_"))
    spans = spans.join(good, same, "left_semi").select(F.col("id").alias("id_"), F.col("h").alias("h_"), F.col("chunk").alias("chunk_"), "begin", "end")
    parts = chunks.join(spans, same & (F.col("chunk") == F.col("chunk_"))).select("id", "h", "chunk", "begin", "end", "text")
    stitched = parts.mapInArrow(partial(_encode_stitched, **use, chunk=chunk), "id long, h long, chunk int, begin long, end long, ids binary")
    stitched = stitched.groupBy("id", "h").applyInPandas(_join, "id long, h long, ids binary")
    lost = whole.where("lost > 0").select(F.col("id").alias("id_"), F.col("h").alias("h_"))
    alone = long.join(lost, same, "left_semi").select("id", "h", "text").mapInArrow(partial(_encode, **use), "id long, h long, ids binary")
    copies = long.select(F.col("id").alias("id_"), F.col("h").alias("h_"), "copies")
    joined = stitched.union(alone).join(copies, same).select("id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "ids").select("id", "ids")
    return short.union(joined).select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of encode() with the column decoded: the bytes of the ids, one after the other. Null ids decode to no bytes."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary"
    return encoded.mapInArrow(partial(_decode, path=path, pattern=pattern), kinds)
