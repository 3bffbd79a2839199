"""Best-fit packing of documents into sequences of bounded length, certified by dual feasible functions.

1. Texts are tokenised; each document ends in `end_id` and is cut into pieces of the capacity.
2. Pieces are dealt to partitions by hash. Each partition packs its pieces by best-fit decreasing and compares its number of
   sequences with a lower bound from dual feasible functions; where they agree, the partition is certified.
3. While the total exceeds the bound of all lengths together, partitions with a gap give back the pieces of their unfilled
   sequences, certified ones those of their emptiest sequence. These pieces are exchanged (dealt anew) and packed again.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.hashing import as_bytes, slices, word_hashes, word_spans
from gaugewell.llm.shared import bounded_batches, stored

PIECES_PER_PARTITION = 20_000
CACHE_WORDS, CACHE_BYTES = 800_000, 20 << 20
BLOCK_WORDS, MARK = 500, b"\x01"
ROUNDS = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordEncoder:
    """Encodes texts word by word with a memory of words, which is emptied when it is full.

    The tokenizer drops white space and no token or normalisation reaches across it, so the ids of a text are the ids of its words.
    Texts are encoded as by the library's plain call, which gives the strings of special tokens their ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes of words in order, and their numbers
        self.start, self.length, self.ids, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), 0

    def learn(self, words: list[bytes]) -> np.ndarray:
        """Encodes new words and gives their numbers: in blocks, with a mark between them that is a token of its own; words that hold
        the mark go alone."""
        plain, blocks = [w for w in words if MARK not in w], []
        for i in range(0, len(plain), BLOCK_WORDS):
            blocks.append((b" " + MARK + b" ").join(plain[i:i + BLOCK_WORDS]).decode())
        odd = [w for w in words if MARK in w]
        starts, lengths, ids, size = [], [], [], len(self.ids)
        for e in self.tokenizer.encode_batch_fast(blocks + [w.decode() for w in odd], add_special_tokens=False):
            ids.append(np.array(e.ids, np.uint32))
            ends = np.append(np.flatnonzero(ids[-1] == self.mark), len(ids[-1])) if len(ids) <= len(blocks) else np.array([len(ids[-1])])
            begins = np.append(0, ends[:-1] + 1)
            starts.append(begins + size)
            lengths.append(ends - begins)
            size += len(ids[-1])
        numbers = np.empty(len(words), np.int64)
        marked = np.array([MARK in w for w in words], bool)
        numbers[np.concatenate([np.flatnonzero(~marked), np.flatnonzero(marked)])] = len(self.start) + np.arange(len(words))
        self.start = np.concatenate([self.start, *starts])
        self.length = np.concatenate([self.length, *lengths])
        self.ids = np.concatenate([self.ids, *ids])
        self.size += sum(map(len, words))
        return numbers

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text. Words are told apart by 64-bit hashes; the distinct ones of the batch are looked up, new ones encoded."""
        data, ends = as_bytes(texts)
        if not len(data):
            return [np.zeros(0, np.uint32)] * len(texts)
        # the tokenizer lowers letters; doing it first in plain ASCII texts leaves fewer words to know. It looks for special tokens
        # before that, so texts that may hold one (`<|`) stay as they are.
        odd = data > 127
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        plain = np.concatenate([[0], np.cumsum(odd)])[ends]
        data = np.where(np.repeat(np.diff(plain) == 0, np.diff(ends)), _LOWER[data], data)
        starts, stops = word_spans(data, ends)
        distinct, first, inverse = np.unique(word_hashes(data, starts, stops), return_index=True, return_inverse=True)
        if len(self.start) > CACHE_WORDS or self.size > CACHE_BYTES:
            self.forget()
        place = np.searchsorted(self.known, distinct)
        new = place == len(self.known)
        new[~new] = self.known[place[~new]] != distinct[~new]
        if new.any():
            numbers = self.learn([data[s:e].tobytes() for s, e in zip(starts[first[new]].tolist(), stops[first[new]].tolist())])
            self.known, self.number = np.insert(self.known, place[new], distinct[new]), np.insert(self.number, place[new], numbers)
        at = self.number[np.searchsorted(self.known, distinct)][inverse]
        lengths = self.length[at]
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.arange(cuts[-1]) + np.repeat(self.start[at] - cuts[:-1], lengths)]
        cuts = cuts[np.searchsorted(starts, ends)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


_ENCODERS: dict[str, WordEncoder] = {}


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = _ENCODERS.setdefault(path, None) or WordEncoder(path)
    _ENCODERS[path] = encoder
    for batch in batches:
        for first, last in slices(batch.column(1)):
            rows = []
            for i, ids in enumerate(encoder.encode(batch.column(1).slice(first, last - first))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                rows += [(first + i, p, s, min(capacity, len(ids) - s), zlib.crc32(ids[s:s + capacity])) for p, s in enumerate(range(0, len(ids), capacity))]
            at, piece, start, length, crc = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "crc"])


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs; counts[x] pieces have length x. The largest bound of two families of dual feasible functions."""
    x = np.arange(capacity + 1, dtype=np.int64)
    if not counts.sum():
        return 0
    best = -(-int((counts * x).sum()) // capacity)
    # f_k: lengths over capacity - k count as a whole sequence, lengths under k as nothing
    number, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * x)])
    k = np.arange(1, capacity // 2 + 1)
    above = number[-1] - number[capacity - k + 1]
    middle = tokens[capacity - k + 1] - tokens[k]
    best = max(best, int((above + -(-middle // capacity)).max()))
    # u_m: round (m + 1) x / capacity down to m-ths, exact multiples stay
    for m in range(1, 21):
        scaled, exact = (m + 1) * x // capacity, (m + 1) * x % capacity == 0
        best = max(best, -(-int((counts * np.where(exact, m * x, scaled * capacity)).sum()) // (m * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece. Open sequences are found by their gap; a bit mask names the gaps in use."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                mask ^= 1 << gap
        else:
            gap, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - gap
        left = gap - n
        if left:
            by_gap[left].append(b)
            mask |= 1 << left
    return bins, offsets


def _pack(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "id", "piece"], ascending=[False, True, True], kind="stable")
    lengths = pdf["length"].to_numpy(np.int64)
    bins, offsets = best_fit_decreasing(lengths, capacity)
    fill = np.bincount(bins, lengths).astype(np.int64)
    certified = len(fill) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    loose = fill < capacity
    if certified:
        loose &= np.arange(len(fill)) == fill.argmin()
    return pdf.assign(bin=bins, offset=offsets, certified=certified, loose=loose[bins])


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, certified.

    Null and empty texts are documents of the end id alone. A document over the capacity is cut into pieces of the capacity, the
    last one shorter. Rows with a null or repeated id are documents of their own. certified tells whether the partition that
    packed the piece met its lower bound. Other columns are ignored. An empty table gives an empty result.
    """
    source = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = stored(source.mapInArrow(partial(_pieces, path=tokenizer_path, capacity=capacity, end_id=end_id),
                                      "id long, piece int, start long, length long, crc long"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # one row per length, so the capacity bounds it
        histogram[length] = n
    bound, total, settled, open_pieces = lower_bound(histogram, capacity), 0, [], pieces
    shape = ", ".join(["id long", "piece int", "start long", "length long", "crc long", "part long", "bin long", "offset long", "certified boolean", "loose boolean"])
    for round_ in range(ROUNDS):
        n = int(histogram.sum()) if round_ == 0 else open_pieces.count()
        parts = max(1, -(-n // PIECES_PER_PARTITION))
        dealt = open_pieces.withColumn("part", F.pmod(F.xxhash64("id", "piece", F.lit(round_)), F.lit(parts)))
        packed = stored(dealt.groupBy("part").applyInPandas(partial(_pack, capacity=capacity), shape))
        packed = packed.withColumn("sequence_id", F.lit(round_ << 56) + F.col("part") * F.lit(1 << 24) + F.col("bin"))
        firm, loose = (packed.where("offset = 0").groupBy().agg(F.count(F.expr("if(loose, null, 1)")), F.count(F.expr("if(loose, 1, null)"))).first())
        total += firm
        if parts == 1 or total + loose <= bound or round_ == ROUNDS - 1:
            settled.append(packed)
            break
        settled.append(packed.where("not loose"))
        open_pieces = packed.where("loose").select("id", "piece", "start", "length", "crc")
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset", "certified")
