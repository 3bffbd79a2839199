"""Risk, review, report and export queries over audits derived from the tables."""

from __future__ import annotations

from catalog.profiling import pct
from catalog.registry import query, table, view, view_sql
from gaugewell.functions import cells
from gaugewell.operators import metrics, report, review, risk
from gaugewell.plans import audit as plan
from gaugewell.sources import sinks
from pyspark.sql import functions as F

_SEV = "coalesce(leakage_severity, '') IN ('critical', 'severe', 'high')"
_REV = "(leakage_count > 0 OR leakage_severity IN ('medium', 'moderate', 'review'))"
_AUDITS = f"""WITH a AS ({view_sql('customer_audits')}), i AS (
    SELECT audit_id, 'data_quality' AS category, 'critical' AS severity, 'The quality score is very low: ' || CAST(quality_score AS VARCHAR) || '.' AS reason FROM a WHERE quality_score < 40
    UNION ALL SELECT audit_id, 'data_quality', 'review', 'The quality score needs a review: ' || CAST(quality_score AS VARCHAR) || '.' FROM a WHERE quality_score >= 40 AND quality_score < 70
    UNION ALL SELECT audit_id, 'possible_leakage', leakage_severity, 'Serious possible leakage.' FROM a WHERE {_SEV}
    UNION ALL SELECT audit_id, 'possible_leakage', leakage_severity, 'Possible leakage needs a review.' FROM a WHERE NOT {_SEV} AND {_REV}
    UNION ALL SELECT audit_id, 'class_imbalance', imbalance_severity, 'Class imbalance can distort scores.' FROM a WHERE imbalance_severity IN ('high', 'severe')
    UNION ALL SELECT audit_id, 'problem_type', 'review', problem_reason FROM a WHERE problem_needs_review),
    g AS (SELECT a.*, (quality_score < 40 OR {_SEV}) AS has_blockers, (SELECT count(*) FROM i WHERE i.audit_id = a.audit_id) AS risk_items_count FROM a)"""


def _aggregated(spark, sf_dir):
    return risk.aggregate(view(spark, sf_dir, "customer_audits"))


@query(f"""{_AUDITS} SELECT audit_id, has_blockers, risk_items_count, risk_items_count > 0 AS requires_human_review,
    concat_ws(',', CASE WHEN quality_score < 40 THEN 'data_quality_below_critical_threshold' END, CASE WHEN {_SEV} THEN 'severe_possible_leakage' END) AS critical_blockers FROM g""")
def risk_aggregation(spark, sf_dir):
    return _aggregated(spark, sf_dir).select(
        "audit_id", "has_blockers", "risk_items_count", "requires_human_review", F.array_join("critical_blockers", ",").alias("critical_blockers"))


@query(f"{_AUDITS} SELECT * FROM i")
def risk_items(spark, sf_dir):
    return risk.risk_items(_aggregated(spark, sf_dir))


_DECIDED = f"""{_AUDITS}, h AS ({view_sql('customer_decisions')}), j AS (SELECT g.*,
    coalesce(lower(trim(final_human_decision)) IN ('approved_for_baseline_experiment_only', 'approved_with_known_risks', 'accept_risk_continue', 'approved', 'approved_with_notes'), false)
        OR coalesce(approved_for_modeling, false) AS yes,
    coalesce(lower(trim(final_human_decision)) IN ('pause_and_fix_data_first', 'reject_modeling_until_fixed', 'needs_fix', 'blocked', 'not_ready_pending_review'), false) AS no
    FROM g LEFT JOIN h ON g.audit_id = h.audit_id)"""


def _routed(goes_on: str) -> str:
    return f"""{_DECIDED} SELECT audit_id, yes AS human_approved, no AS human_blocked, decision, CASE WHEN decision = 'continue_to_modeling' THEN 'continue_to_modeling'
        ELSE 'waiting_for_human_approval' END AS workflow_status FROM (SELECT *, CASE WHEN no THEN 'human_rejected_modeling'
        WHEN risk_items_count > 0 AND NOT ({goes_on}) THEN 'wait_for_human_approval' ELSE 'continue_to_modeling' END AS decision FROM j)"""


_ROUTE_COLUMNS = ["audit_id", "human_approved", "human_blocked", "decision", "workflow_status"]


@query(_routed("yes"))
def risk_router(spark, sf_dir):
    out = risk.route(_aggregated(spark, sf_dir), "human_approved", view(spark, sf_dir, "customer_decisions"))
    return out.select(_ROUTE_COLUMNS)


@query(_routed("risk_items_count = 0"))
def risk_router_gate(spark, sf_dir):
    return risk.route(_aggregated(spark, sf_dir), "human_gate", view(spark, sf_dir, "customer_decisions")).select(_ROUTE_COLUMNS)


@query(_routed("NOT has_blockers"))
def risk_router_auto(spark, sf_dir):
    out = risk.route(_aggregated(spark, sf_dir), "auto", view(spark, sf_dir, "customer_decisions"), stop_on_critical=True)
    return out.select(_ROUTE_COLUMNS)


_SCORED = f"""{_AUDITS}, s AS (SELECT *, greatest(0, least(100, 100 - greatest(0, 100 - CAST(quality_score AS DECIMAL(12, 4))) * CAST(0.35 AS DECIMAL(3, 2))
    - CASE WHEN leakage_severity = 'critical' THEN 30 WHEN {_SEV} THEN 20 WHEN leakage_severity = 'medium' THEN 10 WHEN leakage_count > 0 THEN 5 ELSE 0 END
    - CASE imbalance_severity WHEN 'severe' THEN 12 WHEN 'high' THEN 8 WHEN 'moderate' THEN 4 ELSE 0 END - least(10, 3 * optional_failures) - CASE WHEN has_blockers THEN 15 ELSE 0 END)) AS raw FROM g),
    r AS (SELECT *, CAST(round(raw, 2) AS DOUBLE) AS audit_score, CASE WHEN raw >= 85 THEN 'good_starting_point' WHEN raw >= 70 THEN 'needs_review' WHEN raw >= 50 THEN 'high_review_needed' ELSE 'not_ready' END AS readiness FROM s)"""


def _scored(spark, sf_dir):
    return risk.audit_score(risk.route(_aggregated(spark, sf_dir)))


@query(f"{_SCORED} SELECT audit_id, audit_score, readiness FROM r")
def audit_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("audit_id", "audit_score", "readiness")


@query(f"""{_SCORED} SELECT audit_id, CASE readiness WHEN 'good_starting_point' THEN 'good' WHEN 'needs_review' THEN 'review' ELSE 'high_review' END AS verdict FROM r""")
def audit_verdict(spark, sf_dir):
    return risk.verdict(_scored(spark, sf_dir)).select("audit_id", "verdict")


@query(f"""{_SCORED} SELECT audit_id, target_column, problem_type, 'continue_to_modeling' AS workflow_status, audit_score, readiness, has_blockers, risk_items_count > 0 AS requires_human_review,
    risk_items_count, leakage_count, leakage_severity FROM r""")
def audit_summary(spark, sf_dir):
    return risk.compact_summary(_scored(spark, sf_dir))


@query(f"""{_AUDITS} SELECT category, severity, CASE lower(severity) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'review' THEN 4 WHEN 'none' THEN 5 ELSE 6 END AS severity_rank,
    count(*) AS items FROM i GROUP BY ALL""")
def risk_first_items(spark, sf_dir):
    ranked = risk.risk_items(_aggregated(spark, sf_dir)).withColumn("severity_rank", risk.severity_rank("severity"))
    return ranked.groupBy("category", "severity", "severity_rank").agg(F.count(F.lit(1)).alias("items"))


_ITEMS = f"""{_AUDITS}, q AS (SELECT *, md5(concat_ws(chr(31), audit_id, category, severity, 'none', reason, 'review_before_modeling')) AS review_key FROM i)"""


def _items(spark, sf_dir):
    return review.review_items(risk.risk_items(_aggregated(spark, sf_dir)))


@query(f"""{_ITEMS} SELECT review_key, audit_id, category, severity, reason, 'pending_human_review' AS status FROM q""")
def review_items(spark, sf_dir):
    return _items(spark, sf_dir).select("review_key", "audit_id", "category", "severity", "reason", "status")


@query(f"""{_ITEMS}, m AS (SELECT *, CASE WHEN category = 'data_quality' THEN 'accept_risk_continue' WHEN category = 'possible_leakage' AND severity <> 'critical' THEN 'false_positive' ELSE 'pending_human_review' END AS d FROM q)
    SELECT audit_id, count(*) AS review_items_count, count(*) FILTER (WHERE d = 'pending_human_review') AS pending_items_count, count(*) FILTER (WHERE d = 'pending_human_review') > 0 AS is_pending FROM m GROUP BY audit_id""")
def decision_merge(spark, sf_dir):
    items = _items(spark, sf_dir)
    made = F.when(F.col("category") == "data_quality", "accept_risk_continue").otherwise("false_positive")
    decided = items.where("category = 'data_quality' OR (category = 'possible_leakage' AND severity <> 'critical')")
    decisions = decided.select("review_key", made.alias("human_decision"), F.lit("seen").alias("reviewer_note"))
    return review.review_summary(review.merge_decisions(items, decisions))


@query(f"""{_SCORED} SELECT audit_id, risk_items_count AS review_items_count, risk_items_count > 0 OR readiness <> 'good_starting_point' AS review_required,
    CASE WHEN risk_items_count > 0 OR readiness <> 'good_starting_point' THEN 'review_required_before_modeling' ELSE 'modeling_allowed' END AS next_action FROM r""")
def review_gate(spark, sf_dir):
    out = review.review_gate(_scored(spark, sf_dir), _items(spark, sf_dir))
    return out.select("audit_id", "review_items_count", "review_required", "next_action")


@query(f"""WITH h AS ({view_sql('customer_decisions')}) SELECT audit_id, CASE
    WHEN coalesce(trim(final_human_decision), '') NOT IN ('approved_for_baseline_experiment_only', 'approved_with_known_risks', 'pause_and_fix_data_first', 'reject_modeling_until_fixed', 'not_ready_pending_review') THEN 'unknown_final_decision'
    WHEN pending > 0 AND approved_for_modeling THEN 'approved_with_pending_items'
    WHEN trim(final_human_decision) IN ('approved_for_baseline_experiment_only', 'approved_with_known_risks') AND NOT approved_for_modeling THEN 'approval_without_flag' ELSE 'none' END AS error FROM h""")
def decision_payloads(spark, sf_dir):
    h = view(spark, sf_dir, "customer_decisions")
    body = F.to_json(F.struct("final_human_decision", "approved_for_modeling", F.col("pending").alias("pending_items_count"), F.expr("array('x')").alias("reviewed_items")))
    return review.check_payloads(h.select("audit_id", body.alias("payload"))).select("audit_id", F.coalesce("error", F.lit("none")).alias("error"))


_CLAIM_TEXT = ("concat(text, CASE WHEN n_chars > 4000 THEN ' The model is PRODUCTION READY, guaranteed.' WHEN n_chars > 2000 THEN ' It is not production ready.' "
               "WHEN n_chars > 1000 THEN ' This is confirmed leakage.' ELSE '' END)")
_CLAIMED = f"SELECT *, lower({_CLAIM_TEXT}) AS t FROM documents"


@query(f"""WITH c AS ({_CLAIMED}) SELECT doc_id, concat_ws(',', CASE WHEN contains(t, '99% accuracy') THEN '99% accuracy' END, CASE WHEN contains(t, '100% accuracy') THEN '100% accuracy' END,
    CASE WHEN contains(t, 'production ready') AND NOT contains(t, 'not production ready') AND NOT contains(t, 'not yet production ready') AND NOT contains(t, 'isn''t production ready') THEN 'production ready' END,
    CASE WHEN contains(t, 'confirmed leakage') AND NOT contains(t, 'not confirmed leakage') AND lang <> 'en' THEN 'confirmed leakage' END,
    CASE WHEN contains(t, 'guaranteed') THEN 'guaranteed' END, CASE WHEN contains(t, 'perfect model') THEN 'perfect model' END) AS ungrounded_claims FROM c""")
def ungrounded_claims(spark, sf_dir):
    """Whole document texts; English documents have the leakage claim in their context."""
    texts = table(spark, sf_dir, "documents").withColumn("body", F.expr(_CLAIM_TEXT))
    context = F.when(F.col("lang") == "en", F.lit("confirmed leakage"))
    return report.ungrounded_claims(texts, "body", context).select("doc_id", F.array_join("ungrounded_claims", ",").alias("ungrounded_claims"))


_ASK = ("concat(text, CASE turn WHEN 0 THEN ' Is there leakage?' WHEN 1 THEN ' Which METRIC fits?' WHEN 2 THEN ' What about missing cells?' WHEN 3 THEN ' Is it ready?' "
        "WHEN 4 THEN ' Explain the shap values.' ELSE '' END)")


@query(f"""WITH q AS (SELECT conv_id, turn, lower({_ASK}) AS t FROM conversations), k AS (SELECT *, CASE WHEN contains(t, 'leak') THEN 'leakage' WHEN contains(t, 'metric') THEN 'metric'
    WHEN contains(t, 'model') OR contains(t, 'baseline') THEN 'model' WHEN contains(t, 'quality') OR contains(t, 'missing') THEN 'quality' WHEN contains(t, 'imbalance') OR contains(t, 'class') THEN 'imbalance'
    WHEN contains(t, 'explain') OR contains(t, 'shap') OR contains(t, 'feature') THEN 'explanation' WHEN contains(t, 'ready') OR contains(t, 'final') THEN 'readiness' ELSE 'other' END AS topic FROM q),
    a AS ({view_sql('customer_audits')})
    SELECT conv_id, turn, topic, CASE WHEN topic = 'leakage' THEN 'Possible leakage risks: ' || coalesce(CAST(leakage_count AS VARCHAR), 'not available') || ', severity ' || coalesce(leakage_severity, 'not available') || '; not confirmed, review needed.'
        ELSE topic END AS answer FROM k LEFT JOIN a ON a.audit_id = concat('c', CAST(conv_id AS VARCHAR))""")
def question_routing(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.expr("concat('c', CAST(conv_id AS STRING))").alias("audit_id"), F.expr(_ASK).alias("question"))
    out = report.answer_questions(asked, view(spark, sf_dir, "customer_audits"))
    return out.select("conv_id", "turn", "topic", F.when(F.col("topic") == "leakage", F.col("answer")).otherwise(F.col("topic")).alias("answer"))


@query(f"""{_SCORED} SELECT audit_id, readiness, CAST(audit_score AS VARCHAR) AS audit_score, leakage_severity FROM r""")
def markdown_reports(spark, sf_dir):
    """The values read back from the rendered reports."""
    out = report.markdown(_scored(spark, sf_dir))
    line = lambda pattern: F.regexp_extract("report", pattern, 1)
    return out.select("audit_id", line(r"- Readiness: (\S+)").alias("readiness"), line(r"- Audit score: (\S+)").alias("audit_score"),
                      line(r"## Leakage[^\n]*\n- Risks: [^\n]*\n- Severity: (\S+)").alias("leakage_severity"))


@query(f"""WITH a AS ({view_sql('customer_audits')}) SELECT audit_id, sha256('{{"imbalance_severity":"' || imbalance_severity || '","leakage_count":' || leakage_count || ',"leakage_severity":"' || leakage_severity
    || '","problem_type":"' || problem_type || '"}}') AS context_hash FROM a""")
def context_hashes(spark, sf_dir):
    audits = view(spark, sf_dir, "customer_audits").select("audit_id", "problem_type", "leakage_severity", "leakage_count", "imbalance_severity")
    return report.context_hash(audits).select("audit_id", "context_hash")


_RISKY = "CASE role WHEN 'user' THEN concat('=', text) WHEN 'assistant' THEN concat('@', text) ELSE text END"


@query(f"""WITH c AS (SELECT conv_id, turn, {_RISKY} AS t FROM conversations) SELECT conv_id, turn, md5(CASE WHEN regexp_matches(t, '^[=+@-]') THEN '''' || t ELSE t END) AS text_md5 FROM c""")
def csv_safe_cells(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_RISKY).alias("text"))
    return sinks.csv_rows(df).select("conv_id", "turn", F.md5("text").alias("text_md5"))


@query(f"""WITH d AS ({view_sql('dirty_lineitem')}) SELECT count(*) AS rows, count(*) FILTER (WHERE isinf(l_extendedprice)) AS null_prices, count(*) FILTER (WHERE l_tax IS NULL OR isnan(l_tax)) AS null_taxes FROM d""")
def json_safe_rows(spark, sf_dir):
    rows = sinks.json_rows(view(spark, sf_dir, "dirty_lineitem").select("l_extendedprice", "l_tax"))
    return rows.agg(F.count("value").alias("rows"), F.count_if(F.col("value").contains('"l_extendedprice":null')).alias("null_prices"),
                    F.count_if(F.col("value").contains('"l_tax":null')).alias("null_taxes"))


_LABEL = "concat(p_name, ' (', p_type, ')/', p_brand, ' -- ', CAST(p_size AS STRING), '%')"


@query(f"""WITH p AS (SELECT p_partkey, {_LABEL} AS k FROM part) SELECT p_partkey,
    regexp_replace(regexp_replace(replace(replace(translate(trim(lower(k)), ' -/', '___'), '(', ''), ')', ''), '[^a-zA-Z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS metric_key,
    regexp_replace(regexp_replace(trim(k), '[^a-zA-Z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS param_key FROM p""")
def run_log_keys(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("k", F.expr(_LABEL))
    return df.select("p_partkey", sinks.metric_name(F.col("k")).alias("metric_key"), sinks.param_name(F.col("k")).alias("param_key"))


@query("""SELECT doc_id, CASE WHEN length(text) > 500 THEN md5(substr(text, 1, 485) || '...[truncated]') ELSE md5(text) END AS value_md5 FROM documents""")
def run_log_values(spark, sf_dir):
    """Parameter values are cut in a run log only; the texts themselves are read whole."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(sinks.param_value(F.col("text"))).alias("value_md5"))


_ALIAS = "CASE o_orderstatus WHEN 'F' THEN ' Multi-Class ' WHEN 'O' THEN 'BINARY' ELSE 'Regression' END"


@query(f"""SELECT CASE o_orderstatus WHEN 'F' THEN 'multiclass_classification' WHEN 'O' THEN 'binary_classification' ELSE 'regression' END AS problem_type,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'moderate' ELSE 'high' END AS severity, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Macro F1 Score' ELSE o_orderpriority END AS shown, count(*) AS orders
    FROM orders GROUP BY ALL""")
def metric_aliases(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "Medium").otherwise(" HIGH ")
    shown = F.when(F.col("o_orderpriority") == "1-URGENT", "F1 Macro").otherwise(F.col("o_orderpriority"))
    out = df.select(metrics.normalise_problem_type(F.expr(_ALIAS)).alias("problem_type"), metrics.normalise_severity(severity).alias("severity"),
                    metrics.display_name(shown).alias("shown"))
    return out.groupBy("problem_type", "severity", "shown").agg(F.count(F.lit(1)).alias("orders"))


@query(f"""SELECT event_type, {pct('count(*) FILTER (WHERE value > 100)', 'count(*)')} AS share FROM events GROUP BY event_type""")
def event_shares(spark, sf_dir):
    df = table(spark, sf_dir, "events").groupBy("event_type")
    return df.agg(F.count_if(F.col("value") > 100).alias("k"), F.count(F.lit(1)).alias("n")).select("event_type", cells.percent(F.col("k"), F.col("n")).alias("share"))


@query()
def full_audits(spark, sf_dir):
    """Two whole audits with one decision step: every check runs, training waits for the review."""
    specs = [plan.Spec("orders", table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey"),
             plan.Spec("customer", table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey")]
    _, outcome = plan.audit_many(specs, "human_gate", train=False)
    return outcome["summary"]


def _class_balance(t: str) -> str:
    return f"""SELECT '{t}' AS audit_id, '{t}' AS target_column, CASE WHEN count(*) = 2 THEN 'binary_classification' ELSE 'multiclass_classification' END AS problem_type,
        CASE WHEN ratio < 1.5 AND NOT rare THEN 'low' WHEN ratio < 3 THEN CASE WHEN rare THEN 'moderate' ELSE 'low' END WHEN ratio < 10 THEN 'high' ELSE 'severe' END AS imbalance_severity
        FROM (SELECT *, round(max(c) OVER () / min(c) OVER ()::DOUBLE, 2) AS ratio, bool_or(round(100.0 * c / s, 2) < 5) OVER () AS rare FROM (SELECT {t}, count(*) AS c, sum(count(*)) OVER () AS s FROM orders GROUP BY {t})) GROUP BY ratio, rare"""


@query(f"""WITH d AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS duplicate_rows FROM orders)
    SELECT a.*, CAST(d.duplicate_rows AS BIGINT) AS duplicate_rows FROM ({_class_balance('o_orderstatus')} UNION ALL {_class_balance('o_orderpriority')}
    UNION ALL SELECT 'o_totalprice', 'o_totalprice', 'regression', 'not_applicable' FROM orders HAVING count(DISTINCT o_totalprice) > 50 AND bool_or(o_totalprice % 1 <> 0)) a, d""")
def audits_of_one_table(spark, sf_dir):
    """Three targets of one table audited over one set of column facts."""
    orders = table(spark, sf_dir, "orders")
    audits, _ = plan.audit_many([plan.Spec(t, orders, t, "o_orderkey") for t in ("o_orderstatus", "o_orderpriority", "o_totalprice")], "human_gate", train=False)
    return plan.audits_table(audits).select("audit_id", "target_column", "problem_type", "imbalance_severity", "duplicate_rows")
