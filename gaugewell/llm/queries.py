"""The registered queries of the operators, at their production settings and over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.llm.bpe import decode, encode
from gaugewell.llm.classifier import held_out, labelled_sample
from gaugewell.llm.embedding_dedup import near_vectors
from gaugewell.llm.fingerprints import LEAF, SKETCH, edited_fingerprints
from gaugewell.llm.html_extract import main_text
from gaugewell.llm.lm_scoring import score_documents
from gaugewell.llm.ngram_join import jaccard_join
from gaugewell.llm.packing import pack
from gaugewell.llm.prefix_trie import prefix_trie
from gaugewell.llm.quality import fit as fit_quality
from gaugewell.llm.quality import score_quality
from gaugewell.llm.substring_dedup import substring_dedup
from gaugewell.llm.topk_search import top_k
from gaugewell.llm.toxicity import fit as fit_toxicity
from gaugewell.llm.toxicity import score_toxicity
from gaugewell.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TRAINING_ROWS = 3_000  # labelled rows of each class that fit a classifier
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x20\x09-\x0D]+"


def _query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function
    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


JACCARD_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3])) END AS s FROM words),
posted AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM posted a JOIN posted b ON a.g = b.g AND a.doc_id <> b.doc_id
  WHERE 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.y) AS component_id, min(r.y) = s.doc_id AS kept
FROM sets s JOIN reach r ON s.doc_id = r.x GROUP BY s.doc_id, len(s.s)
"""


@_query("op1_ngram_jaccard_join", JACCARD_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents")).drop("n_links")


SUBSTRING_SQL = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)),
firsts AS (SELECT s, min(doc_id) AS f FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
covered AS (
  SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE doc_id > f), range(50) t(j)),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS k, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM words) ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


@_query("op7_substring_dedup", SUBSTRING_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query("op3_best_fit_packing")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op4_toxicity")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = labelled_sample(docs, _table(spark, sf_dir, "labels"), "toxic", "doc_id", "text", TRAINING_ROWS, "crc32(cast(id as string)) % 3 <> 1")
    scored = score_toxicity(docs, fit_toxicity(rows))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


@_query("op9_byte_level_bpe")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    use = {"path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    rows = decode(encode(_table(spark, sf_dir, "documents"), **use), **use)
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op10_quality_classifier")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = labelled_sample(docs, _table(spark, sf_dir, "labels"), "quality", "doc_id", "text", TRAINING_ROWS, "crc32(cast(id as string)) % 3 <> 1")
    return score_quality(docs, fit_quality(rows)).withColumn("held_out", held_out("doc_id"))


def _print_sql(text: str, source: str, out: str) -> str:
    """CTEs that give (doc_id, sketch, fp) of a text column of a table."""
    return rf"""
{out}_p AS (SELECT doc_id, list_transform(string_split({text}, chr(10)), lambda x: md5(x)) AS p,
  list_sort(list_distinct(list_transform(regexp_extract_all({text}, '{LEAF}'), lambda x: md5(x)[1:8]))) AS leaves FROM {source}),
{out}_b AS (SELECT *, list_filter(range(0, len(p)), lambda i: i = 0 OR p[i + 1][1:1] < '4') AS b FROM {out}_p),
{out}_s AS (SELECT *, list_transform(range(1, len(b) + 1), lambda j: p[b[j] + 1:CAST(coalesce(b[j + 1], len(p)) AS BIGINT)]) AS s FROM {out}_b),
{out} AS (SELECT doc_id, leaves[1:{SKETCH}] AS sketch, list_transform(s, lambda x: md5(array_to_string(x, ''))[1:8]) AS short,
  sha256(array_to_string(list_transform(s, lambda x: md5(array_to_string(x, ''))), '')) || '|' || coalesce(array_to_string(leaves[1:{SKETCH}], ','), '') || '|' ||
  array_to_string(list_transform(s, lambda x: md5(array_to_string(x, ''))[1:8] || ':' || array_to_string(list_transform(x, lambda y: y[1:8]), ',')), ';') AS fp
  FROM {out}_s)"""


def _near_sql(a: str, b: str) -> str:
    union = f"list_sort(list_distinct(list_concat({a}.sketch, {b}.sketch)))[1:{SKETCH}]"
    both = f"len(list_intersect(list_intersect({a}.sketch, {b}.sketch), {union}))"
    return f"CASE WHEN {a}.fp = {b}.fp THEN 1.0::DOUBLE WHEN len({union}) = 0 THEN 0.0::DOUBLE ELSE CAST(2 * {both} AS DOUBLE) / ({both} + len({union})) END"


FINGERPRINT_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
  FROM d WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT *, substr(text, 1, n - n // 3) || substr(next_text, 1, n // 3) AS edited FROM o),
{_print_sql('text', 'e', 'own')},
{_print_sql('edited', 'e', 'changed')}
SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256, own.fp AS fingerprint, changed.fp AS edited_fingerprint,
  {_near_sql('own', 'changed')} AS near_edited, {_near_sql('own', 'nxt')} AS near_next,
  CAST(len(list_filter(own.short, lambda x: NOT list_contains(changed.short, x))) AS INTEGER) AS n_changed
FROM e JOIN own USING (doc_id) JOIN changed USING (doc_id) JOIN own nxt ON nxt.doc_id = e.next_id
"""


@_query("op8_document_fingerprints", FINGERPRINT_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
n AS (SELECT x, count(*) AS c FROM links GROUP BY x)
SELECT v.vec_id, CAST(coalesce(any_value(n.c), 0) AS BIGINT) AS n_links, min(r.y) AS component_id, min(r.y) = v.vec_id AS kept
FROM v JOIN reach r ON v.vec_id = r.x LEFT JOIN n ON n.x = v.vec_id GROUP BY v.vec_id
"""


@_query("op5_embedding_near_dedup", EMBEDDING_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


@_query("op6_html_extraction")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


@_query("op2_lm_scoring")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), order=3)


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


@_query("op12_exact_top_k", TOP_K_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


@_query("op13_embedding_whitening")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


TRIE_SQL = """
WITH own AS (
  SELECT conv_id AS c, coalesce(text, '') AS text, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS dig,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 5 AS base, n, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(s) + 1),
    lambda i: [ascii(s[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295) % 9 AS h
  FROM (SELECT c, count(*) AS n, CAST(c AS VARCHAR) AS s FROM own GROUP BY c)),
heads AS (SELECT v.c, o.pos AS place, o.dig, o.text FROM convs v JOIN own o ON o.c = v.base AND o.pos < v.h),
rebuilt AS (
  SELECT c, place, dig, text FROM heads
  UNION ALL SELECT o.c, o.pos + 1000000000, o.dig, o.text FROM own o JOIN convs v USING (c) WHERE o.pos >= v.h),
placed AS (SELECT c, row_number() OVER w AS depth, md5(string_agg(dig, '') OVER w) AS k, strlen(text) AS size FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY place)),
paths AS (SELECT c, 0 AS depth, '' AS k, 0 AS size FROM convs UNION ALL SELECT c, depth, k, size FROM placed),
steps AS (SELECT *, lag(k) OVER w AS up, lead(k) OVER w IS NULL AS last FROM paths WINDOW w AS (PARTITION BY c ORDER BY depth)),
nodes AS (
  SELECT k, depth, any_value(up) AS up, min(c) AS least, count(*) AS n, any_value(size) AS size, bool_and(last) AS leaf,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends FROM steps GROUP BY k, depth),
own_values AS (
  SELECT s.c, s.depth, s.k, CASE WHEN n.least = s.c THEN (n.n - 1) * n.size ELSE 0 END AS saved, CASE WHEN n.least = s.c AND n.leaf THEN 1 ELSE 0 END AS leaf
  FROM steps s JOIN nodes n USING (k, depth)),
below AS (SELECT k, depth, sum(saved) OVER w AS saved, sum(leaf) OVER w AS leaf FROM own_values WINDOW w AS (PARTITION BY c ORDER BY depth DESC)),
totals AS (SELECT k, depth, sum(saved) AS saved, sum(leaf) AS leaves FROM below GROUP BY k, depth),
children AS (SELECT up AS k, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL)
SELECT n.least AS conv_id, CAST(n.depth AS BIGINT) AS depth, p.least AS parent_conv_id, n.n AS n_convs, coalesce(ch.n, 0) AS n_children,
  CAST(t.leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN totals t USING (k, depth) LEFT JOIN children ch USING (k, depth) LEFT JOIN nodes p ON p.k = n.up AND p.depth = n.depth - 1
"""


@_query("op11_prefix_trie", TRIE_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))
