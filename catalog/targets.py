"""Problem type and class imbalance queries."""

from __future__ import annotations

from catalog.profiling import pct
from catalog.registry import query, table
from gaugewell.operators import imbalance, metrics, problem
from pyspark.sql import functions as F

_BOOL = "('true','yes','y','1','positive','pos','false','no','n','0','negative','neg')"
# (column, numeric, integral) of the tables whose every column is taken as a target.
_COLUMNS = {
    "orders": [("o_orderkey", 1, 1), ("o_custkey", 1, 1), ("o_orderstatus", 0, 0), ("o_totalprice", 1, 0), ("o_orderpriority", 0, 0)],
    "lineitem": [("l_linenumber", 1, 1), ("l_quantity", 1, 0), ("l_discount", 1, 0), ("l_tax", 1, 0), ("l_returnflag", 0, 0),
                 ("l_linestatus", 0, 0), ("l_extendedprice", 1, 0), ("l_suppkey", 1, 1)],
    "labels": [("doc_id", 1, 1), ("quality", 1, 1), ("toxic", 1, 1)],
}


def _stats(t: str, c: str, numeric: int, integral: int) -> str:
    label = f"lower(trim(CAST({c} AS VARCHAR)))"
    bool_like = f"count(DISTINCT {label}) = 2 AND bool_and({label} IN {_BOOL})" if integral or not numeric else "false"
    whole = f"coalesce(bool_and({c} % 1 = 0), false)" if numeric else "false"
    return f"""SELECT '{c}' AS target_column, {'true' if numeric else 'false'} AS num, {bool_like} AS bl, {whole} AS il,
        count(DISTINCT {c}) AS u, {pct(f'count(DISTINCT {c})', f'count({c})')} AS up, count({c}) AS tv, count(*) AS n FROM {t}"""


def _types(tables: list[str]) -> str:
    stats = " UNION ALL ".join(_stats(t, *c) for t in tables for c in _COLUMNS[t])
    return f"""s AS ({stats}), k AS (SELECT *, CASE WHEN u < 2 THEN 'x' WHEN u = 2 OR bl THEN '2' WHEN NOT num THEN 'l' WHEN u <= 20 THEN 'f'
        WHEN il AND up <= 2 THEN 'r' WHEN il AND u <= 50 THEN 's' ELSE 'c' END AS g FROM s),
        p AS (SELECT *, CASE g WHEN 'x' THEN 'invalid_target' WHEN '2' THEN 'binary_classification' WHEN 'l' THEN 'multiclass_classification'
            WHEN 'f' THEN 'multiclass_classification' ELSE 'regression' END AS problem_type,
            CASE g WHEN '2' THEN CASE WHEN bl THEN 'high' ELSE 'medium' END WHEN 'l' THEN CASE WHEN u > 50 THEN 'medium' ELSE 'high' END
            WHEN 'c' THEN 'high' WHEN 'x' THEN 'none' ELSE 'medium' END AS confidence,
            CASE g WHEN '2' THEN NOT bl AND num WHEN 'l' THEN u > 50 WHEN 'c' THEN false ELSE true END AS needs_human_review FROM k)"""


_SHOWN = ["target_column", "is_numeric", "is_bool_like", "is_integer_like", "unique_values", "unique_percent", "total_values",
          "problem_type", "confidence", "needs_human_review"]


@query(f"""WITH {_types(list(_COLUMNS))} SELECT target_column, num AS is_numeric, bl AS is_bool_like, il AS is_integer_like, u AS unique_values,
    up AS unique_percent, tv AS total_values, problem_type, confidence, needs_human_review FROM p""")
def problem_type_many(spark, sf_dir):
    """Every listed column of three tables taken as the target."""
    parts = [problem.problem_types(table(spark, sf_dir, t), [c for c, _, _ in cs]).select(_SHOWN) for t, cs in _COLUMNS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {_types(['lineitem'])}, cls AS (SELECT *, problem_type LIKE '%classification' AS isc FROM p)
    SELECT target_column, 'few_rows' AS warning FROM cls WHERE n < 50 UNION ALL SELECT target_column, 'needs_review' FROM cls WHERE needs_human_review
    UNION ALL SELECT target_column, 'high_cardinality' FROM cls WHERE isc AND u > 50
    UNION ALL SELECT target_column, 'integer_levels' FROM cls WHERE num AND il AND u BETWEEN 5 AND 50
    UNION ALL SELECT target_column, 'positive_class' FROM cls WHERE bl AND problem_type = 'binary_classification'
    UNION ALL SELECT target_column, 'mostly_unique' FROM cls WHERE isc AND up > 80""")
def target_warnings(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return problem.warnings(problem.problem_types(df, [c for c, _, _ in _COLUMNS["lineitem"]])).select("target_column", "warning")


_DIST = "c AS (SELECT {c} AS class, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}), q AS (SELECT *, sum(n) OVER () AS total FROM c)"


@query(f"""WITH {_DIST.format(c='event_type', t='events')} SELECT position, class, count, percent FROM (
    SELECT row_number() OVER (ORDER BY n DESC, class) AS position, class, n AS count, {pct('n', 'total')} AS percent FROM q) WHERE position <= 15""")
def class_preview(spark, sf_dir):
    return problem.class_preview(table(spark, sf_dir, "events"), "event_type")


def _distribution(t: str, c: str) -> str:
    return f"""WITH {_DIST.format(c=f'CAST({c} AS VARCHAR)', t=t)} SELECT class, n AS count, {pct('n', 'total')} AS percent,
        n = max(n) OVER () AS is_majority, n = min(n) OVER () AS is_minority, {pct('n', 'total')} < 5 AS is_rare FROM q"""


@query(_distribution("labels", "toxic"))
def class_distribution(spark, sf_dir):
    return imbalance.class_distribution(table(spark, sf_dir, "labels"), "toxic")


@query(_distribution("documents", "source"))
def class_distribution_documents(spark, sf_dir):
    return imbalance.class_distribution(table(spark, sf_dir, "documents"), "source")


# Severely skewed and moderately skewed targets made from whole tables.
_TARGETS = [("labels", "toxic", "binary_classification"), ("labels", "quality", "binary_classification"),
            ("documents", "lang", "multiclass_classification"), ("events", "event_type", "multiclass_classification"),
            ("lineitem", "CASE WHEN l_quantity = 50 THEN 'bulk' WHEN l_quantity > 40 THEN 'large' ELSE 'usual' END", "multiclass_classification")]
_NAMES = ["toxic", "quality", "lang", "event_type", "order_size"]
_MEASURES = ["valid_target_rows", "num_classes", "majority_count", "minority_count", "majority_class", "minority_class", "rare_classes",
             "imbalance_ratio", "imbalance_severity", "normalized_entropy", "gini_impurity", "effective_class_count", "can_stratify",
             "can_use_3_folds", "can_use_5_folds"]


def _imbalance(t: str, c: str, problem_type: str, name: str) -> str:
    return f"""SELECT '{name}' AS target_column, '{problem_type}' AS problem_type, *, CASE WHEN imbalance_ratio < 3 THEN CASE WHEN rare_classes > 0 THEN 'moderate' ELSE 'low' END
        WHEN imbalance_ratio < 10 THEN 'high' ELSE 'severe' END AS imbalance_severity FROM (
        SELECT CAST(sum(n) AS BIGINT) AS valid_target_rows, count(*) AS num_classes, max(n) AS majority_count, min(n) AS minority_count,
        first(class ORDER BY n DESC, class) AS majority_class, first(class ORDER BY n, class) AS minority_class, count(*) FILTER (WHERE p * 100 < 5) AS rare_classes,
        round(max(n)::DOUBLE / min(n), 2) AS imbalance_ratio, CASE WHEN count(*) FILTER (WHERE p > 0) <= 1 THEN 0.0 ELSE round(-sum(CASE WHEN p > 0 THEN p * log2(p) END) / log2(count(*) FILTER (WHERE p > 0)), 4) END AS normalized_entropy,
        round(greatest(0.0, 1 - sum(p * p)), 4) AS gini_impurity, round(1 / sum(p * p), 4) AS effective_class_count, min(n) >= 2 AS can_stratify,
        min(n) >= 3 AS can_use_3_folds, min(n) >= 5 AS can_use_5_folds FROM (
        SELECT *, round(n * 100.0::DOUBLE / sum(n) OVER (), 2) / 100 AS p FROM (SELECT CAST({c} AS VARCHAR) AS class, count(*) AS n FROM {t} GROUP BY 1)))"""


_REPORT = " UNION ALL BY NAME ".join(_imbalance(*t, n) for t, n in zip(_TARGETS, _NAMES))


def _summaries(spark, sf_dir):
    out = None
    for (t, c, p), name in zip(_TARGETS, _NAMES):
        df = table(spark, sf_dir, t).select(F.expr(c).alias(name))
        part = imbalance.imbalance_summary(df, name, p)
        out = part if out is None else out.unionByName(part)
    return out


@query(_REPORT)
def imbalance_report(spark, sf_dir):
    return _summaries(spark, sf_dir).select("target_column", "problem_type", *_MEASURES)


@query(f"""WITH r AS ({_REPORT}) SELECT target_column, imbalance_severity AS severity, 'class_imbalance' AS category FROM r WHERE imbalance_severity <> 'low'
    UNION ALL SELECT target_column, 'medium', 'rare_classes' FROM r WHERE rare_classes > 0
    UNION ALL SELECT target_column, 'critical', 'insufficient_class_samples' FROM r WHERE minority_count < 2
    UNION ALL SELECT target_column, 'high', 'very_small_minority_class' FROM r WHERE minority_count BETWEEN 2 AND 4""")
def imbalance_findings(spark, sf_dir):
    return imbalance.imbalance_findings(_summaries(spark, sf_dir)).select("target_column", "severity", "category")


def _rule_rows() -> str:
    return ", ".join(f"('{t}', {str(low).lower()}, {i + 1}, '{m}')" for (t, low), ms in imbalance.METRICS.items() for i, m in enumerate(ms))


@query(f"""WITH r AS ({_REPORT}), m(problem_type, low, position, metric) AS (VALUES {_rule_rows()})
    SELECT target_column, CAST(position AS BIGINT) AS position, metric FROM r JOIN m ON r.problem_type = m.problem_type AND (r.imbalance_severity = 'low') = m.low""")
def imbalance_metrics(spark, sf_dir):
    return imbalance.recommended_metrics(_summaries(spark, sf_dir))


@query(f"""WITH r AS ({_REPORT}) SELECT target_column, count(*) AS actions, CAST(min(position) AS BIGINT) AS first_position FROM (
    SELECT target_column, unnest(CASE WHEN imbalance_severity = 'low' AND rare_classes = 0 THEN [1] ELSE [2, 3, 4] END) AS position FROM r
    UNION ALL SELECT target_column, unnest([5, 6]) FROM r WHERE imbalance_severity IN ('moderate', 'high', 'severe')
    UNION ALL SELECT target_column, unnest([7, 8]) FROM r WHERE imbalance_severity IN ('high', 'severe')
    UNION ALL SELECT target_column, 9 FROM r WHERE rare_classes > 0
    UNION ALL SELECT target_column, 10 FROM r WHERE minority_count < 5 AND NOT (imbalance_severity = 'low' AND rare_classes = 0)
    UNION ALL SELECT target_column, 11 FROM r WHERE num_classes > 20 AND NOT (imbalance_severity = 'low' AND rare_classes = 0)) GROUP BY target_column""")
def imbalance_actions(spark, sf_dir):
    return imbalance.recommended_actions(_summaries(spark, sf_dir)).groupBy("target_column").agg(
        F.count(F.lit(1)).alias("actions"), F.min("position").alias("first_position"))


_SKEW = "imbalance_severity IN ('moderate', 'high', 'severe')"


@query(f"""WITH r AS ({_REPORT}) SELECT target_column, problem_type, imbalance_severity,
    CASE WHEN problem_type = 'binary_classification' THEN 'F1 Score' WHEN {_SKEW} THEN 'Macro F1 Score' ELSE 'Weighted F1 Score' END AS primary_metric,
    CASE WHEN problem_type = 'multiclass_classification' AND {_SKEW} THEN 'f1_macro' ELSE 'f1_weighted' END AS scoring_metric,
    CASE WHEN problem_type = 'multiclass_classification' AND {_SKEW} THEN 'f1_macro' ELSE 'f1_score' END AS selection_metric_key,
    'maximize' AS optimization_direction, CAST(CASE WHEN problem_type = 'binary_classification' THEN 8 ELSE 7 END AS BIGINT) AS recommended FROM r""")
def metric_rules(spark, sf_dir):
    out = metrics.recommend(_summaries(spark, sf_dir).select("target_column", "problem_type", "imbalance_severity"))
    return out.select("target_column", "problem_type", "imbalance_severity", "primary_metric", "scoring_metric", "selection_metric_key",
                      "optimization_direction", F.size("recommended_metrics").cast("long").alias("recommended"))


