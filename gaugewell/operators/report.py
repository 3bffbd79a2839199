"""Reports and text checks over tables of audits, texts and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Claims a report must not make without support, and the negated forms that are fine.
CLAIMS = {
    "99% accuracy": [],
    "100% accuracy": [],
    "production ready": [
        "not production ready", "not yet production ready", "isn't production ready", "is not production ready",
    ],
    "confirmed leakage": [
        "not confirmed leakage", "not a confirmed leakage", "not confirmed as leakage",
        "possible leakage risk, not confirmed leakage",
    ],
    "guaranteed": [],
    "perfect model": [],
}

# Words that route a question, first match wins.
TOPICS = [
    ("leakage", ["leak"]), ("metric", ["metric"]), ("model", ["model", "baseline"]),
    ("quality", ["quality", "missing"]), ("imbalance", ["imbalance", "class"]),
    ("explanation", ["explain", "shap", "feature"]), ("readiness", ["ready", "final"]),
]


def ungrounded_claims(texts: DataFrame, text: str, context: Column | None = None, claims: dict[str, list[str]] = CLAIMS) -> DataFrame:
    """Add ungrounded_claims and is_ungrounded to every text row.

    A claim counts when it stands in the text, not in a negated form, and not in
    the context. The claim list is fixed, so this is one projection: whole texts
    are searched in place and nothing is shuffled.
    """
    body = F.lower(F.col(text))
    known = F.lower(context) if context is not None else F.lit("")
    hits = []
    for phrase, negated in claims.items():
        hit = body.contains(phrase) & ~F.coalesce(known, F.lit("")).contains(phrase)
        for n in negated:
            hit = hit & ~body.contains(n)
        hits.append(F.when(hit, F.lit(phrase)))
    return texts.withColumn("ungrounded_claims", F.array_compact(F.array(*hits))).withColumn(
        "is_ungrounded", F.size("ungrounded_claims") > 0
    )


def topic(question: Column) -> Column:
    """Which part of an audit a question asks about."""
    q, out = F.lower(question), F.lit("other")
    for name, words in reversed(TOPICS):
        hit = q.contains(words[0])
        for w in words[1:]:
            hit = hit | q.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def answer_questions(questions: DataFrame, audits: DataFrame) -> DataFrame:
    """Answer (audit_id, question) rows from the audit summaries they refer to."""
    fields = ["leakage_count", "leakage_severity", "primary_metric", "best_model", "best_score", "quality_score",
              "duplicate_rows", "imbalance_severity", "top_feature", "requires_human_review"]
    have = [F.col(f) if f in audits.columns else F.lit(None).alias(f) for f in fields]
    joined = questions.join(audits.select("audit_id", *have), "audit_id", "left").withColumn("topic", topic(F.col("question")))
    show = lambda c: f"coalesce(CAST({c} AS STRING), 'not available')"
    text = f"""CASE topic
        WHEN 'leakage' THEN concat('Possible leakage risks: ', {show('leakage_count')}, ', severity ', {show('leakage_severity')}, '; not confirmed, review needed.')
        WHEN 'metric' THEN concat('Primary metric: ', {show('primary_metric')}, '.')
        WHEN 'model' THEN concat('Best baseline: ', {show('best_model')}, ', score ', {show('best_score')}, '.')
        WHEN 'quality' THEN concat('Quality score: ', {show('quality_score')}, ', repeated rows: ', {show('duplicate_rows')}, '.')
        WHEN 'imbalance' THEN concat('Class imbalance: ', {show('imbalance_severity')}, '.')
        WHEN 'explanation' THEN concat('Most influential feature: ', {show('top_feature')}, '.')
        WHEN 'readiness' THEN concat('Review required: ', {show('requires_human_review')}, '.')
        ELSE 'Ask about leakage, metrics, models, quality, imbalance, explanation or readiness.' END"""
    return joined.select(*questions.columns, "topic", F.expr(text).alias("answer"))


def markdown(audits: DataFrame) -> DataFrame:
    """(audit_id, report): one Markdown report per audit, rendered in parallel."""
    def line(label: str, column: str) -> Column:
        value = F.col(column).cast("string") if column in audits.columns else F.lit(None)
        if column in audits.columns and audits.schema[column].dataType.typeName() == "array":
            value = F.array_join(column, ", ")
        return F.concat(F.lit(f"- {label}: "), F.coalesce(value, F.lit("not available")))
    sections = [
        ("Summary", [("Target", "target_column"), ("Problem type", "problem_type"), ("Status", "workflow_status"),
                     ("Decision", "decision"), ("Readiness", "readiness"), ("Audit score", "audit_score")]),
        ("Risks", [("Review required", "requires_human_review"), ("Blockers", "critical_blockers"), ("Risk items", "risk_items_count")]),
        ("Data quality", [("Quality score", "quality_score"), ("Repeated rows", "duplicate_rows")]),
        ("Leakage (possible, not confirmed)", [("Risks", "leakage_count"), ("Severity", "leakage_severity")]),
        ("Class imbalance", [("Severity", "imbalance_severity")]),
        ("Metric", [("Primary metric", "primary_metric"), ("Scoring", "scoring_metric")]),
        ("Baseline", [("Best model", "best_model"), ("Selection metric", "selection_metric"), ("Score", "best_score")]),
        ("Explanation", [("Method", "explanation_method"), ("Top feature", "top_feature")]),
    ]
    lines: list[Column] = [F.lit("# Dataset audit")]
    for title, entries in sections:
        lines += [F.lit(""), F.lit(f"## {title}")] + [line(a, b) for a, b in entries]
    lines += [F.lit(""), F.lit("Flagged items are hints; a person decides on each of them.")]
    return audits.select("audit_id", F.array_join(F.array(*lines), "\n").alias("report"))


def context_hash(audits: DataFrame) -> DataFrame:
    """(audit_id, context, context_hash): JSON of each audit and its SHA-256, the key for de-duplication.

    Fields are sorted by name and the audit id is left out, so equal results share a hash.
    """
    fields = sorted(c for c in audits.columns if c != "audit_id")
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return audits.select("audit_id", body.alias("context"), F.sha2(body, 256).alias("context_hash"))
