"""Profile queries."""

from __future__ import annotations

import uuid

from catalog.registry import ALL, DOUBLES, GROUP, NUMBERS, STRINGS, dirty, each, finite, query, table, view
from gaugewell.operators import facts, imbalance, profile, split, stats
from gaugewell.sources import readers
from pyspark.sql import functions as F

N = "(SELECT count(*) FROM d)"


def pct(part: str, whole: str) -> str:
    return f"coalesce(round({part} * 100.0::DOUBLE / nullif({whole}, 0), 2), 0.0)"


def _numeric(c: str) -> str:
    v = finite(c)
    n = f"count({v})"
    r = lambda e: f"round(CAST({e} AS DOUBLE), 4)"
    return f"""SELECT '{c}' AS "column", {n} AS count, count(*) - {n} AS missing_count, {pct(f'(count(*) - {n})', 'count(*)')} AS missing_percent,
        {r(f'avg({v})')} AS mean, {r(f'stddev_samp({v})')} AS std, {r(f'min({v})')} AS min, {r(f'quantile_cont({v}, 0.25)')} AS q25,
        {r(f'quantile_cont({v}, 0.5)')} AS median, {r(f'quantile_cont({v}, 0.75)')} AS q75, {r(f'max({v})')} AS max,
        {r(f'skewness({v})')} AS skewness, {r(f'kurtosis({v})')} AS kurtosis,
        count(*) FILTER (WHERE {f'isinf({c})' if c in DOUBLES else 'false'}) AS infinite_count FROM d"""


@query(f"{dirty()} {each(NUMBERS, _numeric)}")
def profile_numeric(spark, sf_dir):
    return profile.numeric_summary(view(spark, sf_dir, "dirty_lineitem"))


@query(f"{dirty()} " + each(NUMBERS, lambda c: f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {f'isinf({c})' if c in DOUBLES else 'false'}) AS infinite_count FROM d"""))
def infinite_counts(spark, sf_dir):
    return profile.infinite_counts(view(spark, sf_dir, "dirty_lineitem"))


def _categorical(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing_count, {pct(f'(count(*) - count({c}))', 'count(*)')} AS missing_percent,
        count(DISTINCT {c}) AS unique_count, {pct(f'count(DISTINCT {c})', 'count(*)')} AS unique_percent FROM d"""


@query(f"{dirty()} {each([c for c in STRINGS if c != 'ship_day'], _categorical)}")
def profile_categorical(spark, sf_dir):
    return profile.categorical_summary(view(spark, sf_dir, "dirty_lineitem"))


def _top(c: str, k: int) -> str:
    return f"""SELECT "column", position, coalesce(value, 'NaN') AS value, count, percent FROM (SELECT '{c}' AS "column",
        row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR) ASC NULLS LAST) AS position, CAST({c} AS VARCHAR) AS value, count(*) AS count,
        {pct('count(*)', N)} AS percent FROM d GROUP BY CAST({c} AS VARCHAR)) WHERE position <= {k}"""


@query(f"{dirty()} {each(STRINGS, lambda c: _top(c, 10))}")
def profile_top_values(spark, sf_dir):
    return profile.top_values(view(spark, sf_dir, "dirty_lineitem"), STRINGS)


@query(f"""{dirty()} SELECT 'is_final' AS "column", count(is_final) AS count, count(*) - count(is_final) AS missing_count,
    {pct('(count(*) - count(is_final))', 'count(*)')} AS missing_percent, count(*) FILTER (WHERE is_final) AS true_count,
    count(*) FILTER (WHERE NOT is_final) AS false_count FROM d""")
def profile_boolean(spark, sf_dir):
    return profile.boolean_summary(view(spark, sf_dir, "dirty_lineitem"))


@query(f"""{dirty()} SELECT 'l_shipdate' AS "column", count(l_shipdate) AS parse_success_count, {pct('count(l_shipdate)', 'count(*)')} AS parse_success_percent,
    count(*) - count(l_shipdate) AS missing_or_invalid_count, strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') AS min, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS max FROM d
    UNION ALL SELECT 'ship_day', count(t), {pct('count(t)', 'count(*)')}, count(*) - count(t), strftime(min(t), '%Y-%m-%d %H:%M:%S'), strftime(max(t), '%Y-%m-%d %H:%M:%S')
    FROM (SELECT try_strptime(ship_day, '%Y-%m-%d') AS t FROM d)""")
def profile_datetime(spark, sf_dir):
    return profile.datetime_summary(view(spark, sf_dir, "dirty_lineitem"))


_DATE_RE = r"^\d{4}-\d{1,2}-\d{1,2}$"


@query(f"{dirty()} " + each(STRINGS, lambda c: f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE trim({c}) <> '') AS n_nonblank,
    count(*) FILTER (WHERE regexp_matches({c}, '{_DATE_RE}')) AS n_parsed,
    round(count(*) FILTER (WHERE regexp_matches({c}, '{_DATE_RE}')) * 1.0::DOUBLE / count(*) FILTER (WHERE trim({c}) <> ''), 4) AS parse_rate,
    count(*) FILTER (WHERE regexp_matches({c}, '{_DATE_RE}')) >= 0.8 * count(*) FILTER (WHERE trim({c}) <> '') AS is_datetime FROM d"""))
def datetime_inference(spark, sf_dir):
    return profile.infer_dates(view(spark, sf_dir, "dirty_lineitem"))


_DTYPE = {c: "double" for c in DOUBLES} | {c: "bigint" for c in NUMBERS[:3]} | {"l_linenumber": "int", "is_final": "boolean"} | {c: "string" for c in STRINGS}


@query(" UNION ALL ".join(
    f"""SELECT CAST({i} AS BIGINT) AS position, '{c}' AS "column", '{'datetime' if c == 'ship_day' else GROUP[c]}' AS type_group"""
    for i, c in enumerate(ALL)))
def type_inference(spark, sf_dir):
    return profile.column_types(view(spark, sf_dir, "dirty_lineitem")).select("position", "column", "type_group")


@query(f"""{dirty()} SELECT 'l_returnflag' AS target_column, true AS target_exists, 'string' AS dtype, count(*) - count(l_returnflag) AS missing_count,
    {pct('(count(*) - count(l_returnflag))', 'count(*)')} AS missing_percent, count(DISTINCT l_returnflag) AS unique_count,
    {pct('count(DISTINCT l_returnflag)', 'count(*)')} AS unique_percent, false AS is_numeric, false AS is_boolean FROM d""")
def profile_target(spark, sf_dir):
    return profile.target_summary(view(spark, sf_dir, "dirty_lineitem"), "l_returnflag")


@query(f"{dirty()} {_top('l_returnflag', 20)}")
def target_values(spark, sf_dir):
    return profile.top_values(view(spark, sf_dir, "dirty_lineitem"), ["l_returnflag"], 20)


@query("""SELECT 'p_size' AS "column", CAST(p_size AS VARCHAR) AS value FROM (SELECT DISTINCT p_size FROM part ORDER BY p_size LIMIT 10)""")
def sample_values(spark, sf_dir):
    return profile.sample_values(table(spark, sf_dir, "part"), "p_size")


@query(f"""{dirty()}, u AS (SELECT count(*) AS u FROM (SELECT DISTINCT * FROM d)), m AS (SELECT {' + '.join(f'(count(*) - count({c}))' for c in ALL)} AS m, count(*) AS n FROM d)
    SELECT n AS row_count, CAST({len(ALL)} AS BIGINT) AS column_count, n - u AS duplicate_rows, {pct('(n - u)', 'n')} AS duplicate_row_percent,
    CAST(m AS BIGINT) AS missing_cells, {pct('m', f'(n * {len(ALL)})')} AS missing_cells_percent, CAST(0 AS BIGINT) AS unsupported_columns FROM m, u""")
def dataset_shape(spark, sf_dir):
    return profile.dataset_shape(view(spark, sf_dir, "dirty_lineitem"))


@query(f"""{dirty()}, s AS (SELECT (SELECT count(*) FROM d) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS u, (SELECT count(*) - count(l_returnflag) FROM d) AS miss)
    SELECT CAST(1 AS BIGINT) AS position, 'few_rows' AS warning FROM s WHERE n < 50 UNION ALL SELECT 3, 'duplicate_rows' FROM s WHERE n > u
    UNION ALL SELECT 6, 'target_missing_values' FROM s WHERE miss > 0""")
def profile_warnings(spark, sf_dir):
    df = view(spark, sf_dir, "dirty_lineitem")
    shape, about = profile.dataset_shape(df), profile.target_summary(df, "l_returnflag")
    return profile.profile_warnings(shape, about).select((F.col("position") + 1).alias("position"), "warning")


@query("""SELECT lang, count(*) AS kept FROM documents GROUP BY lang""")
def bounded_sample_of_everything(spark, sf_dir):
    """A sample bound above the table size keeps every row."""
    return readers.bounded_sample(table(spark, sf_dir, "documents"), 10**12, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))


@query("""SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), CAST(o_orderkey AS VARCHAR)) AS r FROM orders) WHERE r <= 1000""")
def seeded_sample(spark, sf_dir):
    """A sampling operator: the limit is the feature."""
    return readers.bounded_sample(table(spark, sf_dir, "orders"), 1000, "o_orderkey").select("o_orderkey", "o_orderpriority")


@query("""WITH f AS (SELECT lang AS v, 'lang' AS c FROM documents UNION ALL SELECT source, 'source' FROM documents UNION ALL SELECT text, 'text' FROM documents),
    k AS (SELECT c, v, count(*) AS n FROM f GROUP BY c, v)
    SELECT c AS "column", count(v) AS n_distinct, max(n) AS dominant_count FROM k GROUP BY c""")
def document_frequencies(spark, sf_dir):
    """Distinct and dominant cells of whole texts."""
    df = table(spark, sf_dir, "documents")
    rows = facts.gather(df, None, {"frequency"}, ["lang", "source", "text"]).table
    return rows.select("column", "n_distinct", "dominant_count")


@query("""SELECT count(*) AS rows, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS BIGINT) AS duplicate_rows FROM documents""")
def duplicate_documents(spark, sf_dir):
    """Repeated rows without the key column."""
    return stats.duplicate_row_count(table(spark, sf_dir, "documents").select("text", "lang", "source"))


@query("""SELECT CAST(row_number() OVER (ORDER BY n DESC, text) AS BIGINT) AS position, md5(text) AS text_md5, n AS count FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)
    ORDER BY n DESC, text LIMIT 10""")
def top_texts(spark, sf_dir):
    """The ten most frequent texts, ranked by the whole text; the digest is taken afterwards."""
    top = profile.top_values(table(spark, sf_dir, "documents"), ["text"])
    return top.select("position", F.md5("value").alias("text_md5"), "count")


@query("""SELECT md5(repeat(concat(lang, '-', source, ' '), 12)) AS class_md5, count(*) AS count FROM documents GROUP BY lang, source""")
def long_label_distribution(spark, sf_dir):
    """Classes whose labels are over 64 characters long come out whole."""
    df = table(spark, sf_dir, "documents").select(F.repeat(F.concat("lang", F.lit("-"), "source", F.lit(" ")), F.lit(12)).alias("label"))
    return imbalance.class_distribution(df, "label").select(F.md5("class").alias("class_md5"), "count")


@query("""SELECT 'sample' AS side, CAST(least(500, count(*)) AS BIGINT) AS rows FROM lineitem UNION ALL
    SELECT 'test', CAST(ceil(count(*) * 0.2) AS BIGINT) FROM lineitem UNION ALL SELECT 'train', count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) FROM lineitem""")
def exact_sizes_on_repeated_keys(spark, sf_dir):
    """Sample and split of a table by a key that many rows share."""
    df = table(spark, sf_dir, "lineitem")
    sample = split.sample_rows(df, 500, "l_linenumber").agg(F.lit("sample").alias("side"), F.count(F.lit(1)).alias("rows"))
    sides = split.train_test_split(df, "l_linenumber").groupBy(F.when(F.col("is_test"), "test").otherwise("train").alias("side")).agg(F.count(F.lit(1)).alias("rows"))
    return sample.union(sides)


@query("""SELECT p_partkey, concat(p_name, CASE WHEN p_partkey % 3 = 1 THEN ' é' ELSE ' ü' END) AS p_name, p_size, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part""")
def csv_folder(spark, sf_dir):
    """Every part written as CSV files of different encodings and headers, and read back as one table."""
    folder = (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints").rstrip("/") + f"/csv-{uuid.uuid4().hex}"
    parts = table(spark, sf_dir, "part")
    named = parts.select("p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 3 == 1, " é").otherwise(" ü")).alias("p_name"), "p_size", "p_retailprice")
    some = [named.where(F.col("p_partkey") % 3 == k) for k in range(3)]
    some[0].withColumnRenamed("p_partkey", "\ufeffp_partkey").write.option("header", True).csv(f"{folder}/marked")
    some[1].select("p_size", "p_name", "p_retailprice", "p_partkey").write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{folder}/latin")
    some[2].drop("p_retailprice").write.option("header", True).option("quoteAll", True).csv(f"{folder}/quoted")
    df = readers.read_csv(spark, f"{folder}/*")
    return df.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_size", "p_retailprice")
