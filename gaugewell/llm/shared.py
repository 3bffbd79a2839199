"""What several operators need: a place to cut lineage, and connected components of a link table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES_PER_TASK = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a folder of its own only where none is set, as in tests."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints/gaugewell")
    return context.getCheckpointDir()


def bounded_batches(df: DataFrame, rows: int = 2_000) -> DataFrame:
    """The table as it is; sets the session's Arrow batches to `rows` rows at most, since rows of text are large and batches are copied
    between the JVM and Python several times."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def cut(df: DataFrame) -> DataFrame:
    """Small intermediate tables: computed once and kept in the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Larger intermediate tables: the same as Parquet, which is read column by column. Files stay in the shared folder until released."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gaugewell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the files of a `stored` table that nothing reads any more: what was made of it has been written."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/gaugewell-" in path:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A checkpointed table of a few numbers a row, hinted for a broadcast join if it has at most `most` rows; else joined by shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected link table (a, b): rows (node, component), component being the smallest node.

    Large-star and small-star steps alternate until every component is a star around its smallest node, so the number of rounds grows
    with the logarithm of the longest path. The driver keeps books on every task and stage, so a round has as few as it can: of the
    neighbours only smaller ones can be the least, and edges are read in few pieces. Null ends are ignored; nodes without a link to
    another node have no row.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    edges = cut(edges)
    for _ in range(most_rounds):
        ends = F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger")),
                                 F.struct(F.col("lo").alias("node"), F.lit(0).alias("smaller"), F.lit(1).alias("larger"))))
        nodes = edges.select(ends.alias("x")).groupBy("x.node").agg(F.sum("x.smaller").alias("smaller"), F.max("x.larger").alias("larger"))
        n, open_nodes = nodes.agg(F.sum("smaller"), F.count(F.expr("if(smaller + larger > 1, 1, null)"))).first()
        if not open_nodes:  # no node has two smaller neighbours, or smaller and larger ones
            return edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct().union(
                edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")))
        edges = edges.coalesce(2 + n // EDGES_PER_TASK)
        least = edges.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        large = edges.join(least, F.col("lo") == F.col("u"), "left").select(F.coalesce("m", "lo").alias("lo"), "hi")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("m").alias("lo"), F.explode(F.array("hi", "lo")).alias("hi")).where("lo <> hi").distinct()
        edges = cut(small)
    raise RuntimeError("connected components did not settle")
