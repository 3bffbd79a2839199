"""Leakage queries."""

from __future__ import annotations

from catalog.profiling import pct
from catalog.registry import ALL, NUMBERS, _view_name, dirty, each, finite, query, table, view
from gaugewell.operators import leakage
from pyspark.sql import functions as F

TARGET = "l_returnflag"
_WORDS = "target|label|outcome|result|final_result|prediction|predicted|actual|ground_truth|grade|score|rank|pass|fail|status|class|total"
_NAMES = """SELECT p_partkey, concat(lower(p_type), CASE WHEN p_size > 40 THEN '_final_' WHEN p_size > 20 THEN ' ' ELSE '-' END, split_part(p_name, ' ', 2),
    CASE WHEN p_size % 3 = 0 THEN '_result' WHEN p_size % 3 = 1 THEN '.Score' ELSE '' END) AS "column",
    CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 2) ELSE concat(split_part(p_name, ' ', 1), '_', lower(p_type)) END AS target FROM part"""


@query(f"""WITH p AS ({_NAMES}), n AS (SELECT *, translate(trim(lower("column")), '- .', '___') AS c, translate(trim(lower(target)), '- .', '___') AS t FROM p),
    k AS (SELECT *, list_filter(string_split(c, '_'), lambda x: x <> '') AS ct, list_filter(string_split(t, '_'), lambda x: x <> '') AS tt FROM n),
    e AS (SELECT p_partkey, "column", target, array_to_string(list_sort(list_distinct(list_filter(ct, lambda x: x IN ({', '.join("'" + w + "'" for w in _WORDS.split('|'))})))), ',') AS words,
        list_has_any(ct, tt) AS shared, ends_with(c, '_' || t) OR starts_with(c, t || '_') OR list_contains(ct, t) AS explicit FROM k)
    SELECT p_partkey, "column", target, words AS matched_keywords, shared AS target_name_overlap, explicit AS explicit_target_relation FROM e WHERE words <> '' OR shared OR explicit""")
def leak_name(spark, sf_dir):
    """Names made of the words of every part, each against a target made of them."""
    table(spark, sf_dir, "part").createOrReplaceTempView("named_parts")
    pairs = spark.sql(_NAMES.replace('"column"', "`column`").replace("FROM part", "FROM named_parts"))
    return leakage.name_relations(pairs).withColumn("matched_keywords", F.array_join("matched_keywords", ","))


def _same(c: str) -> str:
    text = f"CAST({c} AS VARCHAR)"
    return f"""SELECT '{c}' AS "column", count({text} = {TARGET}) AS compared_rows, count(*) FILTER (WHERE {text} = {TARGET}) AS equal_rows, count(*) AS rows FROM d"""


@query(f"{dirty()} {each([c for c in ALL if c != TARGET], _same)}")
def duplicate_target_stats(spark, sf_dir):
    return leakage.duplicate_target_stats(view(spark, sf_dir, "dirty_lineitem"), TARGET)


_DUPES = f"""s AS ({each([c for c in ALL if c != TARGET], _same)}), r AS (SELECT "column", compared_rows, rows, equal_rows::DOUBLE / compared_rows AS ratio FROM s WHERE compared_rows >= 10)"""


@query(f"""{dirty()}, {_DUPES} SELECT "column", 'critical' AS risk_level, round(ratio, 4) AS same_values_ratio, {pct('compared_rows', 'rows')} AS coverage_percent FROM r WHERE ratio >= 0.95""")
def leak_duplicate_target(spark, sf_dir):
    out = leakage.duplicate_target_risks(view(spark, sf_dir, "dirty_lineitem"), TARGET)
    return out.select("column", "risk_level", F.col("evidence")["same_values_ratio"].cast("double").alias("same_values_ratio"),
                      F.col("evidence")["coverage_percent"].cast("double").alias("coverage_percent"))


def _corr(c: str, t: str) -> str:
    a, b = finite(c), finite(t)
    return f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS compared_rows, round(corr({a}, {b}), 4) AS correlation FROM d"""


@query(f"{dirty()} {each([c for c in NUMBERS if c != 'l_quantity'], lambda c: _corr(c, 'l_quantity'))}")
def correlations(spark, sf_dir):
    out = leakage.correlations(view(spark, sf_dir, "dirty_lineitem"), "l_quantity")
    return out.withColumn("correlation", F.round("correlation", 4))


@query(f"""{dirty()}, r AS ({each([c for c in NUMBERS if c != 'l_quantity'], lambda c: _corr(c, 'l_quantity'))})
    SELECT "column", CASE WHEN abs(correlation) >= 0.98 THEN 'high' ELSE 'medium' END AS risk_level FROM r WHERE abs(correlation) >= 0.9 AND compared_rows >= 10""")
def leak_correlation(spark, sf_dir):
    return leakage.correlation_risks(view(spark, sf_dir, "dirty_lineitem"), "l_quantity").select("column", "risk_level")


def _filled(columns: list[str], where: str) -> str:
    return ", ".join(f"coalesce({finite(c)}, (SELECT quantile_cont({finite(c)}, 0.5) FROM d WHERE {where})) AS {c}" for c in columns)


def _cuts(c: str, source: str) -> str:
    return f"(SELECT quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FROM {source})"


def _mi(c: str, label: str) -> str:
    bins = f"list_sum(list_transform(list_distinct({_cuts(c, 'm')}), lambda x: CASE WHEN m.{c} > x THEN 1 ELSE 0 END))"
    return f"""SELECT '{c}' AS "column", round(greatest(0.0, ln(n) + (sxy - sx - sy) / n - (nx - 1) * (ny - 1) / (2.0 * n)), 4) AS mutual_information, n AS rows_used FROM (
        WITH b AS (SELECT {bins} AS x, {label} AS y FROM m), j AS (SELECT x, y, count(*) AS c FROM b GROUP BY x, y)
        SELECT (SELECT count(*) FROM b) AS n, (SELECT count(DISTINCT x) FROM b) AS nx, (SELECT count(*) FROM (SELECT DISTINCT y FROM b)) AS ny, (SELECT sum(c * ln(c)) FROM j) AS sxy, (SELECT sum(c * ln(c)) FROM (SELECT sum(c) AS c FROM j GROUP BY x)) AS sx,
        (SELECT sum(c * ln(c)) FROM (SELECT sum(c) AS c FROM j GROUP BY y)) AS sy)"""


_MI_CLASS = f"{dirty()}, m AS (SELECT {TARGET}, {_filled(NUMBERS, TARGET + ' IS NOT NULL')} FROM d WHERE {TARGET} IS NOT NULL)"
_MI_SQL = each(NUMBERS, lambda c: _mi(c, TARGET))
_QTY = f"list_sum(list_transform(list_distinct({_cuts('l_quantity', 'm')}), lambda x: CASE WHEN m.l_quantity > x THEN 1 ELSE 0 END))"
_OTHERS = [c for c in NUMBERS if c != "l_quantity"]


@query(f"{_MI_CLASS} {_MI_SQL}")
def mutual_information(spark, sf_dir):
    out = leakage.mutual_information(view(spark, sf_dir, "dirty_lineitem"), TARGET)
    return out.select("column", F.round("mutual_information", 4).alias("mutual_information"), "rows_used")


@query(f"""{dirty()}, m AS (SELECT {_filled(NUMBERS, 'true')} FROM d) {each(_OTHERS, lambda c: _mi(c, _QTY))}""")
def mutual_information_numeric(spark, sf_dir):
    out = leakage.mutual_information(view(spark, sf_dir, "dirty_lineitem"), "l_quantity")
    return out.select("column", F.round("mutual_information", 4).alias("mutual_information"), "rows_used")


@query(f"""{dirty()}, m AS (SELECT {_filled(NUMBERS, 'true')} FROM d), r AS ({each(_OTHERS, lambda c: _mi(c, _QTY))})
    SELECT "column", 'numeric_target_mutual_information_risk' AS risk_type, 'medium' AS risk_level FROM r WHERE mutual_information >= 0.2""")
def leak_mutual_info(spark, sf_dir):
    return leakage.mutual_information_risks(view(spark, sf_dir, "dirty_lineitem"), "l_quantity").select("column", "risk_type", "risk_level")


def _separation(c: str, t: str) -> str:
    return f"""SELECT '{c}' AS "column", abs(max(m) - min(m)) / greatest(abs(max(m)), abs(min(m)), 1e-9) AS ratio, CAST(sum(n) AS BIGINT) AS compared_rows, count(*) AS classes, min(n) AS least
        FROM (SELECT {t}, avg({finite(c)}) AS m, count({finite(c)}) AS n FROM d WHERE {t} IS NOT NULL GROUP BY {t}) WHERE n > 0"""


_SEP = each([c for c in NUMBERS if c != "l_linenumber"], lambda c: _separation(c, "l_linenumber"))


@query(f"""{dirty()}, s AS ({_SEP}) SELECT "column", round(ratio, 4) AS separation_ratio, compared_rows FROM s WHERE classes >= 2 AND least >= 2 AND compared_rows >= 10""")
def class_separation(spark, sf_dir):
    out = leakage.separation(view(spark, sf_dir, "dirty_lineitem"), "l_linenumber")
    return out.select("column", F.round("separation_ratio", 4).alias("separation_ratio"), "compared_rows")


_SEP_DELIVERY = each(NUMBERS, lambda c: _separation(c, "delivery"))


@query(f"""{dirty()}, s AS ({_SEP_DELIVERY}) SELECT "column", 'target_proxy_separation_risk' AS risk_type, round(ratio, 4) AS separation_ratio FROM s WHERE classes >= 2 AND least >= 2 AND compared_rows >= 10 AND ratio >= 0.75""")
def leak_separation(spark, sf_dir):
    out = leakage.separation_risks(view(spark, sf_dir, "dirty_lineitem"), "delivery")
    return out.select("column", "risk_type", F.col("evidence")["separation_ratio"].cast("double").alias("separation_ratio"))


def _ident(t: str, c: str, text: bool) -> str:
    by_name = f"regexp_matches('{c}', '(^|_)(id|uuid|guid|identifier|serial|email|phone|mobile|zipcode|zip|roll_no)$')"
    u = pct(f"count(DISTINCT {c})", "count(*)")
    by_value = f"count(DISTINCT {c}) >= 50 AND {u} >= 95" if text else "false"
    return f"""SELECT '{t}' AS source, '{c}' AS "column", {by_name} AS by_name, {by_value} AS by_value, count(DISTINCT {c}) AS n_distinct, {u} AS unique_percent FROM {t}"""


_ID_COLUMNS = [("documents", "doc_id", 0), ("documents", "text", 1), ("documents", "source", 1), ("documents", "n_chars", 0),
               ("customer", "c_custkey", 0), ("customer", "c_name", 1), ("customer", "c_nationkey", 0), ("customer", "c_acctbal", 0),
               ("events", "event_id", 0), ("events", "user_id", 0), ("events", "value", 0), ("events", "props", 1), ("events", "ts", 0)]
_ID_TARGETS = {"documents": "lang", "customer": "c_mktsegment", "events": "event_type"}


@query(f"""WITH s AS ({' UNION ALL '.join(_ident(t, c, bool(x)) for t, c, x in _ID_COLUMNS)}) SELECT source, "column", CASE WHEN by_name THEN 'medium' ELSE 'low' END AS risk_level, n_distinct FROM s WHERE by_name OR by_value""")
def leak_identifier(spark, sf_dir):
    parts = []
    for t, target in _ID_TARGETS.items():
        out = leakage.identifier_risks(table(spark, sf_dir, t), target)
        parts.append(out.select(F.lit(t).alias("source"), "column", "risk_level", F.col("evidence")["n_distinct"].cast("bigint").alias("n_distinct")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_RISKS = f"""{_MI_CLASS}, {_DUPES}, mi AS ({_MI_SQL}), sep AS ({each(NUMBERS, lambda c: _separation(c, TARGET))}),
    risks AS (SELECT 'l_returnflag_copy' AS col, 'name_based_risk' AS risk_type, 'high' AS lv
        UNION ALL SELECT c, 'name_based_risk', 'medium' FROM (SELECT unnest([{', '.join("'" + c + "'" for c in ALL if c.startswith('l_') and not c.startswith('l_returnflag'))}]) AS c)
        UNION ALL SELECT "column", 'duplicate_target_risk', 'critical' FROM r WHERE ratio >= 0.95
        UNION ALL SELECT "column", 'classification_target_mutual_information_risk', 'medium' FROM mi WHERE mutual_information >= 0.2
        UNION ALL SELECT "column", 'target_proxy_separation_risk', 'medium' FROM sep WHERE classes >= 2 AND least >= 2 AND compared_rows >= 10 AND ratio >= 0.75
        UNION ALL SELECT 'row_ref', 'high_cardinality_identifier_risk', 'low' FROM d HAVING count(DISTINCT row_ref) >= 50 AND {pct('count(DISTINCT row_ref)', 'count(*)')} >= 95),
    ranked AS (SELECT *, CASE lv WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS k FROM risks)"""


def _all_risks(spark, sf_dir):
    return leakage.risks(view(spark, sf_dir, "dirty_lineitem"), TARGET)


@query(f"""{_RISKS} SELECT col AS "column", risk_type, lv AS risk_level, false AS is_confirmed_leakage FROM risks""")
def leak_risks(spark, sf_dir):
    return _all_risks(spark, sf_dir).select("column", "risk_type", "risk_level", "is_confirmed_leakage")


@query(f"""{_RISKS} SELECT col AS "column", min_by(lv, k) AS highest_risk_level, array_to_string(list_sort(list(DISTINCT risk_type)), ',') AS risk_types, count(*) AS risk_count, true AS requires_human_review FROM ranked GROUP BY col""")
def leak_review_columns(spark, sf_dir):
    return leakage.review_columns(_all_risks(spark, sf_dir))


@query(f"""{_RISKS}, v(name) AS (VALUES ('critical'), ('high'), ('medium'), ('low')) SELECT 'level' AS kind, name, count(lv) AS risks FROM v LEFT JOIN risks ON lv = name GROUP BY name
    UNION ALL SELECT 'type', risk_type, count(*) FROM risks GROUP BY risk_type""")
def leak_summary(spark, sf_dir):
    return leakage.risk_summary(_all_risks(spark, sf_dir))


@query(f"""{_RISKS} SELECT count(*) AS total_risks, coalesce(min_by(lv, k), 'none') AS overall_severity FROM ranked""")
def leak_overall(spark, sf_dir):
    return leakage.overall(_all_risks(spark, sf_dir))


@query(f"""{_RISKS} SELECT CAST(position AS BIGINT) AS position FROM (SELECT 0 AS position FROM risks WHERE risk_type = 'duplicate_target_risk' UNION SELECT unnest([1, 2, 3, 4]) FROM risks
    UNION SELECT 10 FROM risks WHERE risk_type = 'high_correlation_risk' UNION SELECT 11 FROM risks WHERE risk_type LIKE '%mutual_information_risk' UNION SELECT 12 FROM risks WHERE risk_type = 'high_cardinality_identifier_risk')""")
def leak_actions(spark, sf_dir):
    return leakage.recommended_actions(_all_risks(spark, sf_dir)).select("position")


_CUSTOMERS = """SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_custkey % 7 AS week,
    CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 AND c_nationkey < 12 THEN 'small' WHEN c_custkey = 5 THEN 'alone' WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS standing
    FROM customer"""


def _digamma(n: str) -> str:
    y = f"(1.0::DOUBLE / (({n} + 6.0::DOUBLE) * ({n} + 6.0::DOUBLE)))"
    steps = " - ".join(f"1.0::DOUBLE / ({n} + {i}.0::DOUBLE)" for i in range(6))
    return f"(ln({n} + 6.0::DOUBLE) - 0.5 / ({n} + 6.0::DOUBLE) - {y} / 12 + {y} * {y} / 120 - {y} * {y} * {y} / 252 + {y} * {y} * {y} * {y} / 240 - {steps})"


# every row against every other: distances to the rows of the class, then the rows inside the interval
_NEIGHBOURS = f"""WITH d AS (SELECT * FROM ({_CUSTOMERS}) WHERE standing IS NOT NULL),
    w AS (SELECT c_custkey AS id, standing AS y, c_custkey::DOUBLE AS c_custkey, c_nationkey::DOUBLE AS c_nationkey, week::DOUBLE AS week,
        coalesce(c_acctbal, (SELECT median(c_acctbal) FROM d)) AS c_acctbal FROM d),
    f AS (SELECT * FROM (UNPIVOT w ON c_custkey, c_nationkey, week, c_acctbal INTO NAME pos VALUE v) WHERE y IN (SELECT standing FROM d GROUP BY 1 HAVING count(*) > 1)),
    near AS (SELECT a.id, a.pos, a.y, a.v, count(*) + 1 AS n_y, list_last(min(abs(a.v - b.v), 3)) AS r FROM f a JOIN f b ON a.pos = b.pos AND a.y = b.y AND a.id <> b.id GROUP BY ALL),
    m AS (SELECT a.id, a.pos, a.n_y, count(*) AS m, count(*) FILTER (WHERE a.y = b.y) AS k_own FROM near a JOIN f b ON a.pos = b.pos
        AND ((r > 0 AND b.v > a.v - r AND b.v < a.v + r) OR (r = 0 AND b.v = a.v)) GROUP BY ALL),
    mi AS (SELECT pos AS "column", greatest(0.0, {_digamma('count(*)')} + avg({_digamma('k_own')} - {_digamma('n_y')} - {_digamma('m')})) AS mi, count(*) AS n FROM m GROUP BY pos)"""


def _customers(spark, sf_dir):
    table(spark, sf_dir, "customer")
    return spark.sql(_CUSTOMERS.replace("FROM customer", f"FROM {_view_name(sf_dir, 'customer')}"))


@query(f"""{_NEIGHBOURS} SELECT "column", round(mi, 6) AS mutual_information, n AS rows_used, 'classification' AS target_kind FROM mi""")
def neighbour_information(spark, sf_dir):
    """Nearest-neighbour mutual information of customer features with a class that follows from some of them."""
    out = leakage.neighbour_information(_customers(spark, sf_dir), "standing")
    return out.withColumn("mutual_information", F.round("mutual_information", 6))


@query(f"""{_NEIGHBOURS} SELECT "column", 'classification_target_mutual_information_risk' AS risk_type, 'medium' AS risk_level, round(mi, 4) AS mutual_information FROM mi WHERE mi >= 0.2""")
def leak_neighbours(spark, sf_dir):
    """The risk rule on top of the nearest-neighbour estimate."""
    out = leakage.mutual_information_risks(_customers(spark, sf_dir), "standing", estimator="neighbours")
    return out.select("column", "risk_type", "risk_level", F.col("evidence")["mutual_information"].cast("double").alias("mutual_information"))
