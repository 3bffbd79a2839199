import pytest

from gaugewell.errors import AuditError
from gaugewell.operators import imbalance, metrics, problem
from gaugewell.functions.small import small_table


def test_problem_types(spark, classification_df, multiclass_df, regression_df):
    r = problem.detect(classification_df, "approved").first()
    assert (r["problem_type"], r["confidence"], r["needs_human_review"]) == ("binary_classification", "high", False)
    r = problem.detect(multiclass_df, "risk_band").first()
    assert (r["problem_type"], r["confidence"]) == ("multiclass_classification", "high")
    r = problem.detect(regression_df, "score").first()
    assert (r["problem_type"], r["confidence"], r["needs_human_review"]) == ("regression", "high", False)


def test_ambiguous_targets(spark):
    rows = [(float(i % 2), i % 7, i // 4, f"k{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "f double, few int, some int, many string")
    got = {r["target_column"]: r for r in problem.problem_types(df, df.columns).collect()}
    assert got["f"]["confidence"] == "medium" and got["f"]["needs_human_review"]  # 0.0 and 1.0 are not boolean labels
    assert got["few"]["problem_type"] == "multiclass_classification" and got["few"]["needs_human_review"]
    assert got["some"]["problem_type"] == "regression" and got["some"]["needs_human_review"]
    assert got["many"]["needs_human_review"] and got["many"]["confidence"] == "medium"


def test_bool_like_labels_and_warnings(spark):
    df = spark.createDataFrame([(" Yes",), ("no",), ("YES",), (None,)], "t string")
    types = problem.detect(df, "t", None)
    assert types.first()["is_bool_like"]
    # Three spellings in three labelled rows: each raw label occurs once.
    assert {r["warning"] for r in problem.warnings(types).collect()} == {"few_rows", "missing_target", "positive_class", "mostly_unique"}


def test_single_value_target_is_an_error(spark):
    with pytest.raises(AuditError):
        problem.detect(spark.createDataFrame([(1,), (1,)], "t int"), "t")


def test_imbalance(classification_df, imbalanced_df, multiclass_df):
    r = imbalance.imbalance_summary(classification_df, "approved", "binary_classification").first()
    assert (r["imbalance_ratio"], r["imbalance_severity"]) == (1.67, "low")
    out = imbalance.imbalance_audit(imbalanced_df, "approved", "binary_classification")
    r = out["summary"].first()
    assert (r["imbalance_ratio"], r["imbalance_severity"], r["rare_classes"]) == (15.67, "severe", 0)
    assert {x["category"] for x in out["findings"].collect()} == {"class_imbalance", "very_small_minority_class"}
    assert [x["metric"] for x in out["metrics"].orderBy("position").collect()][3] == "PR-AUC"
    assert imbalance.imbalance_summary(multiclass_df, "risk_band", "multiclass_classification").first()["imbalance_ratio"] == 1.67
    assert not imbalance.imbalance_summary(multiclass_df, "age", "regression").first()["is_applicable"]


def test_diversity_measures(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 5, "t string")
    r = imbalance.imbalance_summary(df, "t", "binary_classification").first()
    assert (r["normalized_entropy"], r["gini_impurity"], r["effective_class_count"]) == (1.0, 0.5, 2.0)
    tied = imbalance.class_distribution(df, "t").collect()
    assert all(x["is_majority"] and x["is_minority"] for x in tied)


def test_tiny_class(spark):
    df = spark.createDataFrame([(1,)] * 4 + [(0,)], "t int")
    r = imbalance.imbalance_summary(df, "t", "binary_classification")
    assert r.first()["imbalance_severity"] == "high" and not r.first()["can_stratify"]
    assert "insufficient_class_samples" in {x["category"] for x in imbalance.imbalance_findings(r).collect()}


@pytest.mark.parametrize("given, severity, primary, key", [
    ("binary", "low", "F1 Score", "f1_score"), ("Multi-Class", "medium", "Macro F1 Score", "f1_macro"),
    ("classification", "none", "Weighted F1 Score", "f1_score"), ("Regression", None, "RMSE", "rmse"),
])
def test_metric_rules(spark, given, severity, primary, key):
    audits = small_table(spark, [{"problem_type": given, "imbalance_severity": severity}], {"problem_type": "string", "imbalance_severity": "string"})
    r = metrics.recommend(audits).first()
    assert (r["primary_metric"], r["selection_metric_key"]) == (primary, key)
    assert metrics.problem_type_name(given) == r["problem_type"]
