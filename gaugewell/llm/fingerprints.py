"""Merkle fingerprints of texts, in DataFrame functions only.

Paragraphs are lines; a section is a run of paragraphs, and a paragraph whose digest starts with 0-3 begins a new one, so an edit
moves no other border. Digests of paragraphs make those of sections, and these the root. A fingerprint is a string

    root | sketch | section:paragraph,paragraph;section:...

with the SHA-256 root of the section digests, which tests equality, 8 hex digits of the digest of each section and paragraph, which
locate edits, and a sketch of the leaves under the paragraphs, runs of up to three words: the SKETCH smallest leaf digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH = 96
LEAF = r"(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*){1,3}"
ROWS_PER_RANGE, MOST_RANGES = 5_000, 20_000
_NO_ID = -(1 << 63)


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text; a null text counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    leaves = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LEAF), F.lit(0)), lambda x: F.substring(F.md5(x), 1, 8))))
    paragraphs = F.transform(F.split(text, "\n", -1), lambda x: F.md5(x))
    borders = lambda p: F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (F.substring(F.get(p, i), 1, 1) < "4"))
    cut = lambda p, b: F.transform(b, lambda i, j: F.slice(p, i + 1, F.coalesce(F.get(b, j + 1), F.size(p)) - i))
    short = lambda x: F.substring(x, 1, 8)
    # let-bindings by transform over one-element arrays: each level is computed once
    with_paragraphs = F.transform(F.array(paragraphs), lambda p: F.transform(F.array(borders(p)), lambda b: cut(p, b))[0])[0]
    sections = F.transform(with_paragraphs, lambda s: F.struct(F.md5(F.array_join(s, "")).alias("d"), s.alias("p")))
    tree = lambda s: F.array_join(F.transform(s, lambda x: F.concat(short(x["d"]), F.lit(":"), F.array_join(F.transform(x["p"], short), ","))), ";")
    root = lambda s: F.sha2(F.array_join(F.transform(s, lambda x: x["d"]), ""), 256)
    return (F.transform(F.array(sections), lambda s: F.concat(root(s), F.lit("|"), F.array_join(F.slice(leaves, 1, SKETCH), ","), F.lit("|"), tree(s)))[0])


def likeness(one: Column, two: Column) -> Column:
    """Share of leaves that two fingerprinted texts have in common (Dice), estimated from their sketches: 1 for equal texts."""
    a, b = (F.filter(F.split(F.split(x, r"\|")[1], ","), lambda v: v != "") for x in (one, two))
    least = lambda a, b: F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect(a, b), least(a, b)))
    return F.when(one == two, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(2.0 * both, both + F.size(least(a, b))), F.lit(0.0)))


def changed_sections(one: Column, two: Column) -> Column:
    """Sections of the first text, as (position from 0, digest), that the second lacks."""
    a, b = (F.transform(F.split(F.split(x, r"\|")[2], ";"), lambda s: F.split(s, ":")[0]) for x in (one, two))
    numbered = F.transform(a, lambda x, i: F.struct(i.alias("section"), x.alias("digest")))
    return F.filter(numbered, lambda x: ~F.array_contains(b, x["digest"]))


def _ranges(ids: DataFrame) -> list[int]:
    """Ids that end ranges of about ROWS_PER_RANGE rows, ascending; the last is the largest id. All are ids of the table."""
    total, largest = ids.agg(F.count("*"), F.max("key")).first()
    if not total:
        return [0]
    parts = min(MOST_RANGES, max(1, total // ROWS_PER_RANGE))
    found = ids.agg(F.percentile_approx("key", [(i + 1) / parts for i in range(parts)], 10 * parts)).first()[0]
    return sorted({*found, largest})


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, print, next_text, next_print) for each row; next is the next smaller id, after the smallest the largest.

    Rows are dealt by ranges of ids. The row that ends a range goes to the range above it as well, so no range needs another's
    rows. Null texts are empty, null ids come after all others, equal ids are ordered by digest of the text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("id", F.lit(_NO_ID)))
    ends = _ranges(rows.select("key"))
    table, steps = F.array(*[F.lit(x) for x in ends]), [1 << i for i in reversed(range(len(ends).bit_length()))]
    # binary search for the first end that is not below the key
    below = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= len(ends)) & (F.get(table, at + s - 1) < F.col("key")), at + s).otherwise(at))
    rows = rows.withColumn("part", below).withColumn("print", fingerprint(F.col("text")))
    last = F.get(table, F.col("part")) == F.col("key")
    places = F.when(last, F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")),
                                  F.struct(((F.col("part") + 1) % len(ends)).alias("part"), F.lit(True).alias("guest")))
                    ).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))))
    rows = rows.select("id", "key", "text", "print", F.explode(places).alias("place")).select("id", "key", "text", "print", "place.part", "place.guest")
    order = Window.partitionBy("part").orderBy("guest", F.desc("key"), F.md5("text"))
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_print", F.lead("print").over(order))
    return rows.where("not guest").select("id", "text", "print", "next_text", "next_print")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of edited texts, whose last third is replaced by the start of the next document.

    One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_changed (sections of
    the text that the edited text lacks). See with_next for nulls and ties; an empty table gives an empty result, other columns are
    ignored, and a table of one row has itself as the next document.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)))
    rows = rows.withColumn("edited_print", fingerprint(F.col("edited")))
    return rows.select(F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("print").alias("fingerprint"),
                       F.col("edited_print").alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
                       likeness(F.col("print"), F.col("next_print")).alias("near_next"), F.size(changed_sections(F.col("print"), F.col("edited_print"))).alias("n_changed"))
