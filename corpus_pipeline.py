"""Training-text pipeline: toxic, poor, near-copied and repeated text goes, and what stays is packed into sequences.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame; all but the last keep the columns
of documents. Rows with a null id pass every stage as documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.llm import quality, toxicity
from gaugewell.llm.classifier import labelled_sample
from gaugewell.llm.ngram_join import jaccard_join
from gaugewell.llm.packing import pack
from gaugewell.llm.shared import cut, small, stored
from gaugewell.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TRAINING_ROWS = 3_000  # labelled rows of each class that fit a classifier
_TRAINING = "crc32(cast(id as string)) % 3 <> 1"  # a third of the labels stays out, for tests


def _labelled(spark: SparkSession, docs: DataFrame, sf_dir: str, column: str) -> list[tuple[str, int]]:
    return labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), column, "doc_id", "text", TRAINING_ROWS, _TRAINING)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic (compression distance)."""
    model = toxicity.fit(_labelled(spark, docs, sf_dir, "toxic"))
    return toxicity.score_toxicity(docs, model, carry=COLUMNS[2:], keep_text=True).where("predicted = 0").select(*COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (hierarchical empirical Bayes over source and language)."""
    model = quality.fit(_labelled(spark, docs, sf_dir, "quality"))
    return quality.score_quality(docs, model, carry=COLUMNS[2:], keep_text=True).where("accepted").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more."""
    gone = cut(jaccard_join(docs, k=5, num=80, den=100).where("not kept").select("doc_id"))
    return docs.join(small(gone), "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words that stand in a document of smaller id."""
    out = substring_dedup(docs, carry=("lang", "source"), layout=True).withColumnRenamed("kept_text", "text")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents, packed into sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic), ("quality_classifier", drop_poor), ("ngram_jaccard_join", drop_near_copies), ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None  # trained classifiers, compressed lengths and token ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
