import json

import pytest
from pyspark.sql import functions as F

import gaugewell
from gaugewell.errors import AuditError
from gaugewell.functions.small import small_table
from gaugewell.operators import models, report, review, risk
from gaugewell.sources import readers, sinks

SCHEMA = {"audit_id": "string", "target_column": "string", "problem_type": "string", "problem_needs_review": "boolean", "problem_reason": "string",
          "quality_score": "double", "leakage_severity": "string", "leakage_count": "long", "imbalance_severity": "string", "optional_failures": "long"}


def audits(spark, **changes):
    row = {"audit_id": "a", "target_column": "t", "problem_type": "binary_classification", "problem_needs_review": False, "quality_score": 95.0,
           "leakage_severity": "none", "leakage_count": 0, "imbalance_severity": "low", "optional_failures": 0}
    return small_table(spark, [row | changes], SCHEMA)


def test_clean_audit_goes_on(spark):
    a = risk.aggregate(audits(spark))
    assert not a.first()["requires_human_review"]
    for mode in ("auto", "human_gate"):
        assert risk.route(a, mode).first()["decision"] == "continue_to_modeling"
    assert risk.route(a, "human_approved").first()["decision"] == "continue_to_modeling"  # nothing needs a review


def test_blockers_and_modes(spark):
    a = risk.aggregate(audits(spark, quality_score=30.0, leakage_severity="high", leakage_count=2, imbalance_severity="severe", problem_needs_review=True))
    r = a.first()
    assert r["critical_blockers"] == ["data_quality_below_critical_threshold", "severe_possible_leakage"] and r["risk_items_count"] == 4
    assert risk.route(a, "auto").first()["decision"] == "continue_to_modeling"
    assert risk.route(a, "auto", stop_on_critical=True).first()["decision"] == "wait_for_human_approval"
    assert risk.route(a, "human_gate").first()["decision"] == "wait_for_human_approval"
    def decided(value, flag):
        d = small_table(spark, [{"audit_id": "a", "final_human_decision": value, "approved_for_modeling": flag}],
                        {"audit_id": "string", "final_human_decision": "string", "approved_for_modeling": "boolean"})
        return risk.route(a, "human_approved", d).first()["decision"]
    assert decided("approved_with_known_risks", None) == "continue_to_modeling"
    assert decided("needs_fix", True) == "human_rejected_modeling"
    assert decided(None, True) == "continue_to_modeling" and decided("", False) == "wait_for_human_approval"
    with pytest.raises(AuditError):
        risk.route(a, "sometimes")


def test_score_and_readiness(spark):
    s = risk.audit_score(risk.aggregate(audits(spark, quality_score=60.0, leakage_severity="critical", leakage_count=1, imbalance_severity="high", optional_failures=5))).first()
    assert s["audit_score"] == 100 - 14 - 30 - 8 - 10 - 15 and s["readiness"] == "not_ready"


def test_review_items_keys_and_merge(spark):
    a = risk.aggregate(audits(spark, quality_score=50.0))
    actions = small_table(spark, [{"audit_id": "a", "action": review.NO_ACTION}], {"audit_id": "string", "action": "string"})
    items = review.review_items(risk.risk_items(a), actions=actions)
    assert items.count() == 1  # "no action" is not an item
    key = items.first()["review_key"]
    assert key == review.review_items(risk.risk_items(a)).first()["review_key"]
    d = small_table(spark, [{"review_key": key, "human_decision": "accept_risk_continue", "reviewer_note": "fine"}],
                    {"review_key": "string", "human_decision": "string", "reviewer_note": "string"})
    assert review.review_summary(review.merge_decisions(items, d)).first()["pending_items_count"] == 0
    assert review.review_summary(review.merge_decisions(items, d.limit(0))).first()["is_pending"]


@pytest.mark.parametrize("change, error", [
    ({}, None), ({"final_human_decision": "yes"}, "unknown_final_decision"), ({"reviewed_items": {"a": 1}}, "reviewed_items_not_a_list"),
    ({"pending_items_count": "many"}, "pending_items_not_an_integer"), ({"pending_items_count": 2}, "approved_with_pending_items"),
    ({"approved_for_modeling": False}, "approval_without_flag"),
])
def test_payload_rules(spark, change, error):
    payload = {"final_human_decision": "approved_with_known_risks", "approved_for_modeling": True, "pending_items_count": 0, "reviewed_items": []} | change
    df = spark.createDataFrame([(json.dumps(payload),)], "payload string")
    assert review.check_payloads(df).first()["error"] == error


def test_claims_and_topics(spark):
    df = spark.createDataFrame([("A Perfect Model, guaranteed",), ("it is not production ready",), ("production ready",)], "t string")
    got = [r["ungrounded_claims"] for r in report.ungrounded_claims(df, "t").collect()]
    assert got == [["guaranteed", "perfect model"], [], ["production ready"]]
    grounded = report.ungrounded_claims(df, "t", F.lit("guaranteed perfect model")).first()
    assert not grounded["is_ungrounded"]
    asked = spark.createDataFrame([("Which metric for leakage?",), ("Is the class ready?",), ("hello",)], "q string")
    assert [r[0] for r in asked.select(report.topic(F.col("q"))).collect()] == ["leakage", "imbalance", "other"]


def test_csv_round_trip_and_header_checks(spark, tmp_path, classification_df):
    path = tmp_path / "plain.csv"
    path.write_text("age,city,approved\n18,north,1\n19,south,0\n")
    df = readers.read_csv(spark, str(path))
    assert df.dtypes == [("age", "int"), ("city", "string"), ("approved", "int")] and df.count() == 2
    latin = tmp_path / "latin.csv"
    latin.write_bytes("name,v\ncaf\xe9,1\n".encode("latin-1"))
    assert readers.read_csv(spark, str(latin)).first()["name"] == "café"
    bom = tmp_path / "bom.csv"
    bom.write_bytes("﻿name,v\nx,1\n".encode())
    assert readers.read_csv(spark, str(bom)).columns == ["name", "v"]
    for text in ("a,a\n1,2\n", "a,\n1,2\n", "", "a,b\n"):
        bad = tmp_path / f"bad{abs(hash(text))}.csv"
        bad.write_text(text)
        with pytest.raises(AuditError):
            readers.read_csv(spark, str(bad))
    assert readers.preview(classification_df, 3).count() == 3


def test_safe_exports(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", float("nan")), ("ok", float("inf")), ("-x", 1.5)], "t string, v double")
    assert [r["t"] for r in sinks.csv_rows(df).collect()] == ["'=1+1", "ok", "'-x"]
    assert [json.loads(r["value"])["v"] for r in sinks.json_rows(df).collect()] == [None, None, 1.5]
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).count() == 3 and spark.read.csv(str(tmp_path / "c"), header=True).count() == 3
    keys = spark.createDataFrame([(" F1 (macro)/mean ",), ("%%",)], "k string")
    assert [r[0] for r in keys.select(sinks.metric_name(F.col("k"))).collect()] == ["f1_macro_mean", "metric"]
    assert keys.select(F.length(sinks.param_value(F.repeat(F.lit("x"), 600)))).first()[0] == 500 - 15 + len(sinks.CUT_MARK)


def test_full_audit_gate_then_approval(spark, leaky_df, tmp_path):
    audited, outcome = gaugewell.review_gate(leaky_df, "result")
    line = outcome["decisions"].first()
    assert line["decision"] == "wait_for_human_approval" and line["has_blockers"] and outcome["review_items"].count() > 3
    assert "Decision: wait_for_human_approval" in outcome["reports"].first()["report"]
    d = small_table(spark, [{"audit_id": "audit", "final_human_decision": "approved", "approved_for_modeling": True}],
                    {"audit_id": "string", "final_human_decision": "string", "approved_for_modeling": "boolean"})
    settings = models.Settings(trees=3, depth=3, max_iter=5, cross_validate=False)
    audited, outcome = gaugewell.after_approval(audited, leaky_df, d, "student_id", settings)
    line = outcome["decisions"].first()
    assert line["decision"] == "continue_to_modeling" and line["best_model"] and line["top_feature"] and not audited.failures
    run = sinks.append_run(audited.baseline, str(tmp_path / "log"))
    runs = spark.read.parquet(str(tmp_path / "log" / "runs"))
    assert runs.where(F.col("parent_id") == run).select("run_id").distinct().count() == 2
    rows = runs.count()
    assert sinks.append_run(audited.baseline, str(tmp_path / "log"), run) == run and sinks.append_run(audited.baseline, str(tmp_path / "log"), "007", False) == "007"
    logged = sinks.read_runs(spark, str(tmp_path / "log"))
    assert logged["runs"].where(F.col("log_id") == run).count() == rows == logged["runs"].where("log_id = '007'").count()
    assert {r["log_id"] for r in logged["metrics"].select("log_id").distinct().collect()} == {run, "007"}
    sinks.write_report({"findings": audited.tables["findings"]}, outcome["reports"], str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report" / "html"), wholetext=True).count() == 1


def test_a_folder_of_different_csv_files(spark, tmp_path):
    folder = tmp_path / "many files"
    folder.mkdir()
    (folder / "a.csv").write_bytes("name,v\ncafé,1\n".encode())
    (folder / "b.csv").write_bytes("\n\nv,name\n2,cr\xe8me\n".encode("latin-1"))
    (folder / "c.csv").write_bytes('\ufeff"name","v","more, or less"\n"th\u00e9",3,x\n'.encode())
    (folder / "d.csv").write_bytes(b"")
    (folder / "e.csv").write_bytes("name,v\nplain,2.5\n".encode())
    df = readers.read_csv(spark, str(folder))
    assert df.columns[:2] == ["name", "v"] and dict(df.dtypes) == {"name": "string", "v": "double", "more, or less": "string"}
    assert sorted(tuple(r) for r in df.select("name", "v").collect()) == [("café", 1.0), ("crème", 2.0), ("plain", 2.5), ("thé", 3.0)]
    assert df.where("name = 'thé'").first()["more, or less"] == "x"
    assert dict(readers.read_csv(spark, str(folder), schema="name string, v int").dtypes)["v"] == "int"
    (folder / "f.csv").write_bytes(b"name,name\n1,2\n")
    with pytest.raises(AuditError):
        readers.read_csv(spark, str(folder))


def test_targets_of_one_table_share_its_facts(spark, leaky_df, monkeypatch):
    from gaugewell.operators import facts, profile
    from gaugewell.plans import audit as plan

    asked, whole = [], []
    gather, repeated = facts.gather, profile.duplicate_rows
    monkeypatch.setattr(facts, "gather", lambda *a, **k: asked.append(1) or gather(*a, **k))
    monkeypatch.setattr(profile, "duplicate_rows", lambda df: whole.append(1) or repeated(df))
    targets = [c for c in leaky_df.columns if c != "student_id"][-2:]
    audits, _ = plan.audit_many([plan.Spec(t, leaky_df, t) for t in targets], train=False)
    assert len(asked) == len(whole) == 1
    for a in audits:
        alone = plan.checks(leaky_df, a.target, a.audit_id)
        assert alone.row == a.row
        for name in ("findings", "risks", "columns"):
            assert sorted(map(str, alone.tables[name].collect())) == sorted(map(str, a.tables[name].collect()))
