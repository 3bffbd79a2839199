"""Data-quality queries on the dirty lineitem view with target l_returnflag."""

from __future__ import annotations

from catalog.profiling import _DTYPE, pct
from catalog.registry import ALL, DOUBLES, GROUP, dirty, each, finite, query, view
from gaugewell.operators import facts as facts_mod, quality
from pyspark.sql import functions as F

TARGET = "l_returnflag"
_ID_RE = r"(^|_)(id|uuid|guid|identifier|serial|email|phone|mobile|zipcode|zip|roll_no|roll|aadhaar|pan|ssn)$"
_INT, _FLT = "^[+-]?[0-9]+$", "^[+-]?([0-9]+[.][0-9]*|[.][0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$"
_DAY = r"^\d{4}-\d{1,2}-\d{1,2}$"


def _fact(c: str) -> str:
    v, number, text = finite(c), GROUP[c] == "numeric", GROUP[c] == "categorical"
    inf = f"(SELECT count(*) FROM d WHERE isinf({c}))" if c in DOUBLES else "0"
    if number and c != TARGET:
        q = f"(SELECT quantile_cont({v}, 0.25) AS a, quantile_cont({v}, 0.75) AS b, count({v}) AS n FROM d)"
        out = f"(SELECT count(*) FROM d, {q} AS q WHERE q.n >= 10 AND q.b <> q.a AND ({v} < q.a - 1.5::DOUBLE * (q.b - q.a) OR {v} > q.b + 1.5::DOUBLE * (q.b - q.a)))"
    else:
        out = "0"
    if text:
        kind = (f"CASE WHEN regexp_matches(trim({c}), '{_INT}') THEN 'int' WHEN regexp_matches(trim({c}), '{_FLT}') THEN 'float' "
                f"WHEN lower(trim({c})) IN ('true', 'false') THEN 'bool' WHEN regexp_matches(trim({c}), '{_DAY}') THEN 'timestamp' ELSE 'text' END")
        kinds = f"(SELECT count(DISTINCT {kind}) FROM d WHERE {c} IS NOT NULL)"
    else:
        kinds = "0"
    return f"""SELECT '{c}' AS col, '{GROUP[c]}' AS grp, {str(c == TARGET).lower()} AS tgt, '{_DTYPE.get(c, 'timestamp')}' AS dtype,
        (SELECT count(*) FROM d) AS n, (SELECT count({c}) FROM d) AS present, (SELECT count(DISTINCT {c}) FROM d) AS nd,
        (SELECT max(k) FROM (SELECT count(*) AS k FROM d GROUP BY {c})) AS dom,
        (SELECT count(*) FROM (SELECT count(*) AS k FROM d WHERE {c} IS NOT NULL GROUP BY {c}) WHERE {pct('k', '(SELECT count(*) FROM d)')} < 1) AS rare,
        {inf} AS inf, (SELECT count({v}) FROM d) AS valid, {out} AS outl, {kinds} AS kinds"""


_FACTS = f"""{dirty()}, f0 AS ({each(ALL, _fact)}),
    f AS (SELECT *, n - present AS miss, {pct('(n - present)', 'n')} AS missp, {pct('nd', 'n')} AS up, {pct('dom', 'n')} AS domp,
        {pct('outl', 'valid')} AS outp, {pct('rare', 'nd')} AS rarep, regexp_matches(lower(col), '{_ID_RE}') AS idn,
        grp = 'categorical' AND {pct('nd', 'n')} >= 95 AS idv FROM f0)"""

_RULES = {
    "target": "SELECT 'critical' AS severity, 'invalid_target' AS category, col FROM f WHERE tgt AND nd < 2",
    "missing": """SELECT CASE WHEN tgt OR missp >= 50 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN tgt THEN 'target_missing_values' WHEN missp >= 50
        THEN 'high_missing_values' ELSE 'moderate_missing_values' END AS category, col FROM f WHERE (tgt AND missp > 0) OR (NOT tgt AND missp >= 20)""",
    "constant": "SELECT 'medium' AS severity, 'constant_column' AS category, col FROM f WHERE NOT tgt AND nd + CASE WHEN miss > 0 THEN 1 ELSE 0 END <= 1",
    "near_constant": "SELECT 'low' AS severity, 'near_constant_column' AS category, col FROM f WHERE NOT tgt AND domp >= 95",
    "cardinality": "SELECT CASE WHEN up >= 95 THEN 'high' ELSE 'medium' END AS severity, 'high_cardinality_column' AS category, col FROM f WHERE NOT tgt AND grp = 'categorical' AND nd >= 50",
    "ids": "SELECT CASE WHEN idv THEN 'high' ELSE 'medium' END AS severity, 'possible_id_column' AS category, col FROM f WHERE NOT tgt AND (idn OR idv)",
    "mixed": "SELECT 'medium' AS severity, 'mixed_type_column' AS category, col FROM f WHERE NOT tgt AND kinds > 1",
    "infinite": "SELECT CASE WHEN tgt THEN 'high' ELSE 'medium' END AS severity, 'infinite_values' AS category, col FROM f WHERE inf > 0",
    "outliers": "SELECT CASE WHEN outp >= 5 THEN 'medium' ELSE 'low' END AS severity, 'outliers' AS category, col FROM f WHERE NOT tgt AND outl > 0",
    "rare": "SELECT 'low' AS severity, 'rare_categories' AS category, col FROM f WHERE NOT tgt AND grp = 'categorical' AND rare > 0 AND rarep >= 20",
    "duplicate_rows": f"""SELECT CASE WHEN {pct('(n - u)', 'n')} < 5 THEN 'medium' ELSE 'high' END AS severity, 'duplicate_rows' AS category, NULL AS col
        FROM (SELECT (SELECT count(*) FROM d) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS u) WHERE n > u""",
    "duplicate_columns": """SELECT 'medium' AS severity, 'duplicate_columns' AS category, 'quantity_copy' AS col FROM d HAVING bool_and(l_quantity IS NOT DISTINCT FROM quantity_copy)""",
}
_ALL_FINDINGS = f"{_FACTS}, found AS ({' UNION ALL '.join(f'SELECT * FROM ({r})' for r in _RULES.values())})"


def _measured(check: str, measures: str) -> str:
    return f"""{_FACTS} SELECT r.severity, r.category, r.col AS "column", {measures} FROM ({_RULES[check]}) r JOIN f ON f.col = r.col"""


def _found(spark, sf_dir, checks=None):
    return quality.findings(view(spark, sf_dir, "dirty_lineitem"), TARGET, checks)


def _e(key: str, kind: str = "bigint"):
    return F.col("evidence")[key].cast(kind).alias(key)


_KEY = ["severity", "category", "column"]


@query(_measured("missing", "f.miss AS n_missing, f.missp AS missing_percent"))
def missing_findings(spark, sf_dir):
    return _found(spark, sf_dir, ["missing"]).select(*_KEY, _e("n_missing"), _e("missing_percent", "double"))


@query(f"""{_FACTS} SELECT severity, category, CAST((SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS BIGINT) AS duplicate_rows FROM ({_RULES['duplicate_rows']})""")
def duplicate_rows(spark, sf_dir):
    return _found(spark, sf_dir, ["duplicate_rows"]).select("severity", "category", _e("duplicate_rows"))


@query(f"""{_FACTS} SELECT severity, category, col AS "column", 'l_quantity' AS column_a FROM ({_RULES['duplicate_columns']})""")
def duplicate_columns(spark, sf_dir):
    return _found(spark, sf_dir, ["duplicate_columns"]).select(*_KEY, _e("column_a", "string"))


@query(_measured("constant", "f.nd AS n_distinct"))
def constant_columns(spark, sf_dir):
    return _found(spark, sf_dir, ["constant"]).select(*_KEY, _e("n_distinct"))


@query(_measured("near_constant", "f.dom AS dominant_count, f.domp AS dominant_percent"))
def near_constant(spark, sf_dir):
    return _found(spark, sf_dir, ["near_constant"]).select(*_KEY, _e("dominant_count"), _e("dominant_percent", "double"))


@query(_measured("cardinality", "f.nd AS n_distinct, f.up AS unique_percent"))
def high_cardinality(spark, sf_dir):
    return _found(spark, sf_dir, ["cardinality"]).select(*_KEY, _e("n_distinct"), _e("unique_percent", "double"))


@query(_measured("ids", "f.nd AS n_distinct, f.idn AS id_by_name, f.idv AS id_by_value"))
def id_columns(spark, sf_dir):
    return _found(spark, sf_dir, ["ids"]).select(*_KEY, _e("n_distinct"), _e("id_by_name", "boolean"), _e("id_by_value", "boolean"))


@query(f"""{_FACTS} SELECT r.severity, r.category, r.col AS "column", (SELECT count(*) FROM d WHERE mixed_cell = '7') AS n_int,
    (SELECT count(*) FROM d WHERE mixed_cell = '1.5') AS n_float, (SELECT count(*) FROM d WHERE mixed_cell = 'true') AS n_bool,
    (SELECT count(*) FROM d WHERE mixed_cell = '2024-01-31') AS n_timestamp, (SELECT count(*) FROM d WHERE mixed_cell = 'n/a') AS n_text FROM ({_RULES['mixed']}) r""")
def mixed_types(spark, sf_dir):
    return _found(spark, sf_dir, ["mixed"]).select(*_KEY, *[_e(f"n_{k}") for k in ("int", "float", "bool", "timestamp", "text")])


@query(f"""{_FACTS} SELECT r.severity, r.category, r.col AS "column", (SELECT count(*) FROM d WHERE l_extendedprice = 'Infinity'::DOUBLE) AS pos_inf,
    (SELECT count(*) FROM d WHERE l_extendedprice = '-Infinity'::DOUBLE) AS neg_inf FROM ({_RULES['infinite']}) r""")
def infinite_values(spark, sf_dir):
    return _found(spark, sf_dir, ["infinite"]).select(*_KEY, _e("pos_inf"), _e("neg_inf"))


@query(_measured("outliers", "f.outl AS n_outliers, f.outp AS outlier_percent"))
def iqr_outliers(spark, sf_dir):
    return _found(spark, sf_dir, ["outliers"]).select(*_KEY, _e("n_outliers"), _e("outlier_percent", "double"))


@query(_measured("rare", "f.rare AS n_rare, f.nd AS n_distinct, f.rarep AS rare_percent"))
def rare_categories(spark, sf_dir):
    return _found(spark, sf_dir, ["rare"]).select(*_KEY, _e("n_rare"), _e("n_distinct"), _e("rare_percent", "double"))


@query(f"""{_FACTS} SELECT col AS target_column, dtype, miss AS missing_count, missp AS missing_percent, nd AS unique_count, up AS unique_percent,
    grp = 'numeric' AS is_numeric, inf AS infinite_count, CASE WHEN grp = 'numeric' THEN valid END AS valid_numeric_count, nd < 2 AS is_invalid
    FROM f WHERE col IN ('l_extendedprice', '{TARGET}')""")
def target_quality(spark, sf_dir):
    df = view(spark, sf_dir, "dirty_lineitem")
    return quality.target_quality(df, "l_extendedprice").unionByName(quality.target_quality(df, TARGET))


@query(f"""{_FACTS} SELECT 'x' AS severity, 'invalid_target' AS category, col AS "column" FROM f WHERE col = 'source_system' AND nd < 2""")
def invalid_target(spark, sf_dir):
    found = quality.findings(view(spark, sf_dir, "dirty_lineitem"), "source_system", ["target"])
    return found.select(F.when(F.col("severity") == "critical", "x").alias("severity"), "category", "column")


@query(f"""{_ALL_FINDINGS} SELECT severity, category, coalesce(col, '-') AS "column", severity IN ('critical', 'high', 'medium') AS requires_human_review FROM found""")
def quality_findings(spark, sf_dir):
    return _found(spark, sf_dir).select("severity", "category", F.coalesce("column", F.lit("-")).alias("column"), "requires_human_review")


_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
_PEN = "CASE severity WHEN 'critical' THEN 35.0 WHEN 'high' THEN 15.0 WHEN 'medium' THEN 7.0 WHEN 'low' THEN 2.0 ELSE 0.0 END::DOUBLE"
_CAP = """CASE category WHEN 'high_missing_values' THEN 30 WHEN 'moderate_missing_values' THEN 21 WHEN 'near_constant_column' THEN 10 WHEN 'outliers' THEN 12
    WHEN 'rare_categories' THEN 8 WHEN 'possible_id_column' THEN 30 WHEN 'high_cardinality_column' THEN 30 ELSE 1e9 END::DOUBLE"""
_SCORE = f"""sc AS (SELECT greatest(0.0::DOUBLE, 100 - coalesce(sum(least(cap, pen)), 0)) AS score FROM (SELECT category, {_CAP} AS cap, sum({_PEN}) AS pen FROM found GROUP BY category))"""


@query(f"""{_ALL_FINDINGS}, {_SCORE} SELECT round(score, 2) AS score, CASE WHEN score >= 90 THEN 'good' WHEN score >= 75 THEN 'needs_review' WHEN score >= 50 THEN 'poor' ELSE 'critical' END AS health_label FROM sc""")
def quality_score(spark, sf_dir):
    return quality.quality_score(_found(spark, sf_dir))


@query(f"""{_ALL_FINDINGS} SELECT category, coalesce(col, '-') AS "column", severity, penalty FROM (SELECT *, least(pen, greatest(0.0::DOUBLE, {_CAP} - spent)) AS penalty FROM (
    SELECT *, {_PEN} AS pen, coalesce(sum({_PEN}) OVER (PARTITION BY category ORDER BY {_RANK}, col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS spent FROM found)) WHERE penalty > 0""")
def quality_penalties(spark, sf_dir):
    return quality.penalties(_found(spark, sf_dir)).withColumn("column", F.coalesce("column", F.lit("-")))


@query(f"""{_FACTS}, found AS ({' UNION ALL '.join(f'SELECT * FROM ({_RULES[k]})' for k in ('missing', 'constant', 'near_constant', 'cardinality', 'ids', 'rare'))})
    SELECT f.col AS "column", f.tgt AS is_target, miss AS missing_count, missp AS missing_percent, nd AS unique_count, up AS unique_percent,
    (SELECT count(*) FROM found WHERE found.col = f.col) AS finding_count FROM f""")
def column_quality(spark, sf_dir):
    df = view(spark, sf_dir, "dirty_lineitem")
    checks = ["missing", "constant", "near_constant", "cardinality", "ids", "rare"]
    facts = facts_mod.gather(df, TARGET, {"frequency"})
    found = quality.findings(df, TARGET, checks, facts)
    return quality.column_quality(facts, found).drop("dtype")


@query(f"""{_ALL_FINDINGS}, lv(s) AS (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info'))
    SELECT 'severity' AS kind, s AS name, count(category) AS findings, coalesce(bool_or(severity IN ('critical', 'high', 'medium')), false) AS requires_human_review FROM lv LEFT JOIN found ON s = severity GROUP BY s
    UNION ALL SELECT 'category', category, count(*), bool_or(severity IN ('critical', 'high', 'medium')) FROM found GROUP BY category
    UNION ALL SELECT 'total', 'all', count(*), coalesce(bool_or(severity IN ('critical', 'high', 'medium')), false) FROM found""")
def finding_summary(spark, sf_dir):
    return quality.finding_summary(_found(spark, sf_dir))


@query(f"""{_FACTS} SELECT col AS "column", miss AS missing_count, missp AS missing_percent, miss = n AS is_empty, missp >= 50 AS is_high_missing FROM f WHERE miss > 0""")
def missing_columns(spark, sf_dir):
    return quality.missing_columns(facts_mod.gather(view(spark, sf_dir, "dirty_lineitem"), TARGET))


@query(f"""{_ALL_FINDINGS}, a AS (SELECT category || CASE WHEN category = 'infinite_values' AND col = '{TARGET}' THEN '/target' ELSE '' END AS advice,
    row_number() OVER (ORDER BY {_RANK}, category, coalesce(col, 'None')) AS place FROM found), g AS (SELECT advice, min(place) AS place FROM a GROUP BY advice)
    SELECT row_number() OVER (ORDER BY place) AS position FROM g""")
def quality_actions(spark, sf_dir):
    """One action per distinct recommendation, in finding order."""
    return quality.recommended_actions(_found(spark, sf_dir)).select("position")


@query(f"""{_ALL_FINDINGS} SELECT row_number() OVER (ORDER BY {_RANK}, category, coalesce(col, 'None')) AS position,
    '[' || upper(severity) || ']' || coalesce(' ' || col || ':', '') AS head FROM found""")
def quality_warnings(spark, sf_dir):
    lines = quality.quality_warnings(_found(spark, sf_dir))
    return lines.select("position", F.regexp_extract("warning", r"^(\[[A-Z]+\]( [a-z_]+:)?)", 1).alias("head"))


