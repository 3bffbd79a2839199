"""Readers: CSV with encoding fallback and header checks, previews and bounded samples."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gaugewell.errors import AuditError
from gaugewell.operators import split
from gaugewell.operators.schema import check_structure

PREVIEW_ROWS = 100_000


def _header_names(spark: SparkSession, line: str, sep: str) -> list[str]:
    """Names on a header line, as written. The CSV reader itself renames repeated and blank ones."""
    line = line.lstrip("\ufeff")
    n = line.count(sep) + 1
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)])
    row = spark.createDataFrame([(line,)], "value string").select(
        F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"sep": sep}).alias("r")
    ).select("r.*").first()
    names = ["" if v is None else v for v in row]
    return names[: max((i + 1 for i, v in enumerate(row) if v is not None), default=1)] if '"' in line else names


def csv_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, bad_utf8, header) for each file with a line that is not empty, from one scan.

    Lines are tested as they lie in the file: `bad_utf8` tells that one is not UTF-8 (a replacement character is good UTF-8);
    `header` is the first line's bytes.
    """
    lines = spark.read.text(path).where("value <> ''").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("at"))
    first = F.when(F.col("start") == 0, F.col("value").cast("binary"))
    return lines.groupBy("file").agg(
        F.bool_or(~F.is_valid_utf8("value")).alias("bad_utf8"), F.coalesce(F.min_by(first, F.when(first.isNotNull(), F.col("at"))), F.min_by(F.col("value").cast("binary"), "at")).alias("header"))


def _merged_type(kinds: list[T.DataType]) -> T.DataType:
    """The type that files agree on; numbers widen, anything else becomes text."""
    if len({k.simpleString() for k in kinds}) == 1:
        return kinds[0]
    if all(isinstance(k, T.NumericType) for k in kinds):
        return T.LongType() if all(isinstance(k, T.IntegralType) for k in kinds) else T.DoubleType()
    return T.StringType()


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, sep: str = ",", encoding: str | None = None
) -> DataFrame:
    """Read a CSV file, or a folder of them, with headers. Types are inferred unless a schema is given.

    Without an encoding each file is read as UTF-8, or as ISO-8859-1 if one of its lines is not UTF-8. Files may have their columns in
    different orders and lack some, which are null then. Repeated and blank header names are errors, files without a line are passed over.
    """
    files = csv_files(spark, path).collect()  # one row per file
    if not files:
        raise AuditError("The CSV file is empty.")
    groups: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    known: dict[str, tuple[str, ...]] = {}
    for f in sorted(files, key=lambda f: f["file"]):
        used = encoding or ("ISO-8859-1" if f["bad_utf8"] else "UTF-8")
        line = bytes(f["header"]).decode(used, errors="replace")
        if line not in known:
            known[line] = tuple(_header_names(spark, line, sep))
        names = known[line]
        repeated = sorted({n for n in names if n.strip() and names.count(n) > 1})
        if repeated:
            raise AuditError(f"Repeated column names: {repeated}")
        if any(not n.strip() for n in names):
            raise AuditError("The CSV header has blank column names.")
        groups.setdefault((used, names), []).append(unquote(f["file"]))  # the column holds it as a URI
    if schema is not None and len(groups) == 1:
        ((used, _), paths), = groups.items()
        return check_structure(_reader(spark, used, sep).schema(schema).csv(paths))
    fixed = {f.name: f.dataType for f in (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema or [])}
    found = {key: _reader(spark, key[0], sep).option("inferSchema", schema is None).csv(paths) for key, paths in groups.items()}
    if len(found) == 1:
        return check_structure(*found.values())
    kinds: dict[str, list[T.DataType]] = {}
    for (_, names), df in found.items():
        for name, f in zip(names, df.schema.fields):
            kinds.setdefault(name, []).append(f.dataType)
    types = {n: fixed.get(n) or _merged_type(k) for n, k in kinds.items()}
    out = None
    for (used, names), paths in groups.items():
        own = T.StructType([T.StructField(n, types[n]) for n in names])
        part = _reader(spark, used, sep).schema(own).csv(paths)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return check_structure(out)


def _reader(spark: SparkSession, encoding: str, sep: str):
    return spark.read.option("header", True).option("sep", sep).option("encoding", encoding)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read any Spark source and check its structure."""
    return check_structure(spark.read.format(fmt).options(**options).load(path))


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows, for a look at the data only."""
    return df.limit(rows)


def bounded_sample(df: DataFrame, max_rows: int, key: str | list[str] | None = None, seed: int = 42) -> DataFrame:
    """Optional row cap: a seeded sample of max_rows rows that does not depend on partitioning.

    Audits do not need it; they run over all rows.
    """
    return split.sample_rows(df, max_rows, key, seed)
