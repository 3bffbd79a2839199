"""The pipeline on documents with planted toxic, poor, near-copied and repeated text, against a brute-force version."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
INSULTS, WORD = ["zorgle", "blarfen", "quimbat", "drosk"], re.compile(r"[^\x20\x09-\x0D]+")


def planted(seed: int = 4):
    """(documents, labels, ids of toxic and of poor documents)."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioustrnlm") for _ in range(3 + i % 6)) for i in range(900)]
    passage, rows, labels, toxic, poor = [rng.choice(vocabulary) for _ in range(60)], [], [], set(), set()
    for i in range(700):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 160))]
        if i % 7 == 0:
            toxic.add(i)
            for _ in range(8):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        elif i % 7 == 1:
            poor.add(i)
            words = [w.upper() + "!!" for w in words]
        elif i % 7 == 2 and i > 20:
            words = [w if rng.random() > 0.01 else "edit" for w in rows[i - 14][1].split(" ")]
        elif i % 21 == 3:
            words[20:20] = passage
        rows.append((i, " ".join(words), "en", f"src{i % 5}", len(" ".join(words))))
        labels.append((i, int(i not in poor), int(i in toxic)))
    rows += [(900, None, None, None, None), (901, "", "en", "src1", 0), (None, "no id here", "en", "src1", 10)]
    return rows, labels, toxic, poor


def near_copies(texts: dict[int, str]) -> set[int]:
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.lower())
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and label[a] != label[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                one, other = sorted((label[a], label[b]))
                label = {k: one if v == other else v for k, v in label.items()}
    return {i for i in label if label[i] != i}


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels, toxic, poor = planted()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, out = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        out.append(docs.collect())
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    ids = [{r.doc_id for r in rows_} for rows_ in out[:4]]
    clean = {i for i in range(700)} - toxic
    assert len(toxic & ids[0]) <= 0.1 * len(toxic) and len(clean - ids[0]) <= 0.02 * len(clean)
    assert len(poor & ids[1]) <= 0.05 * len(poor) and len((clean - poor) - ids[1]) <= 0.02 * len(clean)
    assert all({900, 901, None} <= x for x in ids)
    before = {r.doc_id: r.text or "" for r in out[1] if r.doc_id is not None}
    assert ids[2] == ids[1] - near_copies(before)
    kept, first, want = {r.doc_id: r.text or "" for r in out[2] if r.doc_id is not None}, {}, {}
    for i, t in sorted(kept.items()):
        w = WORD.findall(t)
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j:j + 50]), i)
    for i, t in kept.items():
        w = WORD.findall(t)
        gone = {x for j in range(len(w) - 49) if first[tuple(w[j:j + 50])] < i for x in range(j, j + 50)}
        want[i] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t
    got = {r.doc_id: r.text or "" for r in out[3] if r.doc_id is not None}
    assert got == want and any(want[i] != kept[i] for i in want)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = []
    for r in out[3]:
        x = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        pieces += [(repr(r.doc_id), p, len(x[s:s + 4096]), zlib.crc32(x[s:s + 4096].tobytes())) for p, s in enumerate(range(0, len(x), 4096))]
    assert sorted((repr(r.doc_id), r.piece, r.length, r.ids_crc32) for r in out[4]) == sorted(pieces)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
