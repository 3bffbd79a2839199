"""Baseline models: fit, score, cross-validate and compare."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from gaugewell.errors import TrainingError
from gaugewell.functions import cells
from gaugewell.functions.small import small_table
from gaugewell.operators import evaluate, prep, split
from gaugewell.operators.folds import linear_fold_scores
from gaugewell.operators.metrics import problem_type_name
from gaugewell.operators.schema import columns_of, validate_target

MAX_CLASSES = 10_000  # classes a classifier may have; each one is a row of coefficients


@dataclass
class Settings:
    test_size: float = 0.2
    seed: int = 42
    folds: int = 5
    cross_validate: bool = True
    trees: int = 200
    depth: int = 30  # the deepest tree Spark grows
    min_leaf: int = 2
    max_iter: int = 1000
    classification_default: str = "f1_weighted"
    regression_default: str = "rmse"
    encoder: dict[str, Any] = field(default_factory=dict)
    groups: dict[str, Any] = field(default_factory=dict)


@dataclass
class Baseline:
    """Result of a baseline run: small tables, fitted models and the lazily scored test rows."""

    problem_type: str
    target: str
    classes: list[str]
    groups: prep.FeatureGroups
    metrics: DataFrame
    best: DataFrame
    failures: DataFrame
    details: DataFrame
    confusion: DataFrame
    models: dict[str, PipelineModel]
    encoder: PipelineModel
    train: DataFrame
    test: DataFrame
    warnings: list[str]


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """(label, weight) with weight n / (classes * class rows)."""
    sizes = train.groupBy(label).agg(F.count(F.lit(1)).alias("cnt"))
    n, k = sizes.agg(F.sum("cnt")).scalar(), sizes.agg(F.count(F.lit(1))).scalar()
    return sizes.select(label, (n.cast("double") / (k * F.col("cnt"))).alias("weight"))


def regression_target_check(df: DataFrame, target: str) -> DataFrame:
    """One row (present, numeric, distinct_at_least_2, error)."""
    info = columns_of(df, [target])[0]
    raw = cells.present(target, info.dtype)
    x = cells.finite(target, info.dtype) if info.group == "numeric" else F.expr(f"try_cast(`{target}` AS DOUBLE)")
    infinite = cells.is_infinite(target, info.dtype, 1) | cells.is_infinite(target, info.dtype, -1)
    return df.agg(
        F.count(raw).alias("present"), F.count(x).alias("numeric"), F.count_if(infinite).alias("infinite"),
        (F.min(x) < F.max(x)).alias("varies"),
    ).withColumn("error", F.expr(
        "CASE WHEN numeric = 0 THEN 'no_numeric_values' WHEN NOT coalesce(varies, false) THEN 'one_distinct_value' "
        "WHEN present - infinite > numeric THEN 'non_numeric_values' END"))


def split_check(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Classes that only the test side has."""
    return test.select(label).distinct().join(train.select(label).distinct(), label, "left_anti")


def baseline_estimators(problem_type: str, s: Settings, rows: int) -> dict[str, Any]:
    """The two baseline estimators of a problem type, in order."""
    if problem_type == "regression":
        return {
            "Linear Regression": LinearRegression(labelCol="label", regParam=0.0),
            "Random Forest Regressor": RandomForestRegressor(
                labelCol="label", numTrees=s.trees, maxDepth=s.depth, minInstancesPerNode=s.min_leaf, featureSubsetStrategy="all", seed=s.seed),
        }
    if problem_type not in ("binary_classification", "multiclass_classification"):
        raise TrainingError(f"Unsupported problem type: {problem_type}")
    return {
        # L2 penalty of strength 1 on the summed loss; balanced weights sum to the row count.
        "Logistic Regression": LogisticRegression(
            labelCol="label", weightCol="weight", maxIter=s.max_iter, regParam=1.0 / max(1, rows), standardization=False),
        "Random Forest Classifier": RandomForestClassifier(
            labelCol="label", weightCol="weight", numTrees=s.trees, maxDepth=s.depth, minInstancesPerNode=s.min_leaf,
            featureSubsetStrategy="sqrt", seed=s.seed),
    }


def _scores(predicted: DataFrame, problem_type: str, n_classes: int) -> DataFrame:
    if problem_type == "regression":
        return evaluate.regression_metrics(predicted)
    # Indices are padded so that their text order is the label order.
    padded = predicted.withColumns({
        "truth": F.lpad(F.col("label").cast("int").cast("string"), 6, "0"), "guess": F.lpad(F.col("prediction").cast("int").cast("string"), 6, "0")})
    out = evaluate.classification_metrics(padded, problem_type, "truth", "guess", positive="000001")
    chance = predicted.withColumn("p", vector_to_array("probability"))
    if problem_type == "binary_classification" and n_classes == 2:
        return out.unionByName(evaluate.binary_auc(chance.withColumn("score", F.col("p")[1]).withColumn("y", F.col("label").cast("int")), "score", "y", "1"))
    if problem_type == "multiclass_classification" and n_classes > 2:
        return out.unionByName(evaluate.multiclass_auc(chance, "p", "label", n_classes))
    return out


# Metric by which folds are scored for a configured metric.
_CV_SCORE = {"accuracy": "accuracy", "balanced_accuracy": "balanced_accuracy", "f1_macro": "f1_macro", "macro_f1": "f1_macro",
             "f1": "f1_binary", "f1_binary": "f1_binary", "precision": "precision_binary", "precision_binary": "precision_binary",
             "precision_weighted": "precision_weighted", "recall": "recall_binary", "recall_binary": "recall_binary",
             "recall_weighted": "recall_weighted", "roc_auc": "roc_auc", "roc_auc_ovr_weighted": "roc_auc_ovr_weighted"}


def cross_validate(train: DataFrame, estimator: Any, encoder: prep.FeatureEncoder, problem_type: str, n_classes: int, s: Settings, folds: int,
                   encoders: dict[int, PipelineModel] | None = None) -> list[dict[str, Any]]:
    """Mean and population deviation of the fold scores on the training rows. `train` has a fold column.

    `encoders` keeps the encoder fitted for each fold, for the next estimator on the same folds.
    """
    encoders = {} if encoders is None else encoders
    name = "rmse" if problem_type == "regression" else _CV_SCORE.get(s.classification_default, "f1_score")
    scores, g = [], encoder.groups
    closed = isinstance(estimator, LinearRegression) and encoder.numeric_strategy == "median" and not g.categorical and not g.datetime
    if closed:  # least squares on numbers: all folds from one pass
        scores = linear_fold_scores(train, g.numeric, "label", folds)
    for k in range(0 if closed else folds):
        inner, outer = train.where(F.col("fold") != k), train.where(F.col("fold") == k)
        if k not in encoders:
            encoders[k] = encoder.fit(inner)
        fitted = encoders[k]
        model = estimator.fit(_weighted(fitted.transform(inner), problem_type))
        predicted = model.transform(fitted.transform(outer))
        value = _scores(predicted, problem_type, n_classes).where(F.col("metric") == name).first()
        if value is not None:
            scores.append(value["value"])
    if not scores:
        return []
    mean = sum(scores) / len(scores)
    std = (sum((x - mean) ** 2 for x in scores) / len(scores)) ** 0.5
    return [{"metric": "cv_mean", "value": round(mean, 4)}, {"metric": "cv_std", "value": round(std, 4)}]


def _weighted(df: DataFrame, problem_type: str) -> DataFrame:
    if problem_type == "regression":
        return df
    return df.join(F.broadcast(class_weights(df, "label")), "label")  # at most MAX_CLASSES rows, checked on entry


def train_baselines(
    df: DataFrame, target: str, problem_type: str, key: str | list[str] | None = None, settings: Settings | None = None,
    only: list[str] | None = None,
) -> Baseline:
    """Fit the baselines on 80 % of the rows and score them on the rest. A failing model becomes a row of `failures`."""
    s, spark = settings or Settings(), df.sparkSession
    problem_type = problem_type_name(problem_type)
    target = validate_target(df, target)
    if problem_type == "regression":
        error = regression_target_check(df, target).first()["error"]
        if error:
            raise TrainingError(f"The regression target is unusable: {error}.")
    keys = [] if key is None else [key] if isinstance(key, str) else list(key)
    cleaned = prep.clean_target(df, target)
    groups = prep.feature_groups(cleaned, target, **s.groups)
    rows = prep.split_features(cleaned, target, groups, keep=keys)
    info, warnings, classes = columns_of(df, [target])[0], [], []
    text = cells.text_key(target, info.dtype)
    if problem_type == "regression":
        numeric = cells.finite(target, info.dtype) if info.group == "numeric" else F.expr(f"try_cast(`{target}` AS DOUBLE)")
        labelled = rows.withColumn("label", numeric)
    else:
        found = rows.select(text.alias("c")).groupBy("c").agg(F.lit(1).alias("one")).limit(MAX_CLASSES + 1).select("c").collect()
        if len(found) > MAX_CLASSES:
            raise TrainingError(f"More than {MAX_CLASSES} classes: the target looks like an identifier.")
        classes = sorted(r["c"] for r in found)
        coder = StringIndexerModel.from_labels(classes, "__class", outputCol="label", handleInvalid="error")
        labelled = coder.transform(rows.withColumn("__class", text)).drop("__class")
    sided = split.train_test_split(labelled, keys or None, target if classes else None, s.test_size, s.seed).persist()
    train, test = sided.where("NOT is_test"), sided.where("is_test")
    n_train, n_test = train.count(), test.count()
    if classes:
        here = train.select("label").distinct().count()
        if here < 2:
            raise TrainingError("The training side has fewer than 2 classes.")
        missing = [classes[int(r["label"])] for r in split_check(train, test, "label").collect()]
        if missing:
            warnings.append(f"Classes only in the test rows: {sorted(missing)}.")
    folds = split.safe_folds(train, "label" if classes else None, s.folds) if s.cross_validate else None
    if s.cross_validate and folds is None:
        warnings.append("Too few rows per class for cross-validation.")
    folded = split.assign_folds(train, keys or None, "label" if classes else None, folds, s.seed).persist() if folds else None
    encoder = prep.FeatureEncoder(groups, **s.encoder)
    fitted = encoder.fit(train)
    encoded_train, encoded_test = _weighted(fitted.transform(train), problem_type).persist(), fitted.transform(test).persist()
    measured, failed, models, tables, fold_encoders = [], [], {}, [], {}
    for position, (name, estimator) in enumerate(baseline_estimators(problem_type, s, n_train).items()):
        if only and name not in only:
            continue
        try:
            model = estimator.fit(encoded_train)
            predicted = model.transform(encoded_test)
            scores = [r.asDict() for r in _scores(predicted, problem_type, len(classes)).collect()]
            if folded is not None:
                scores += cross_validate(folded, estimator, encoder, problem_type, len(classes), s, folds, fold_encoders)
            measured += [{"position": position, "model": name} | m for m in scores]
            models[name] = PipelineModel(stages=[*fitted.stages, model])
            if classes:
                pairs = evaluate.confusion(predicted.select(F.col("label").cast("int"), F.col("prediction").cast("int")))
                tables += [{"model": name, "label": classes[int(r["label"])], "prediction": classes[int(r["prediction"])], "count": r["count"]} for r in pairs.collect()]
        except Exception as error:  # a failed baseline is recorded, the others go on
            failed.append({"model": name, "error_type": type(error).__name__, "message": str(error)[:500]})
    encoded_train.unpersist(), encoded_test.unpersist()
    if folded is not None:
        folded.unpersist()
    if not measured:
        raise TrainingError("All baseline models failed: " + "; ".join(f["message"] for f in failed))
    metrics = small_table(spark, measured, {"position": "long", "model": "string", "metric": "string", "value": "double"})
    defaults = {"classification_default": s.classification_default, "regression_default": s.regression_default}
    details = [{
        "test_size": s.test_size, "seed": s.seed, "cross_validation_enabled": folds is not None, "requested_folds": s.folds, "actual_folds": folds,
        "train_rows": n_train, "test_rows": n_test, "classes": classes, "numeric_columns": groups.numeric, "categorical_columns": groups.categorical,
        "datetime_columns": groups.datetime, "unsupported_columns": groups.unsupported, "dropped_columns": groups.dropped, "warnings": warnings,
    }]
    longs = {k: "long" for k in ("seed", "requested_folds", "actual_folds", "train_rows", "test_rows")}
    lists = {k: "strings" for k in ("classes", "numeric_columns", "categorical_columns", "datetime_columns", "unsupported_columns", "dropped_columns", "warnings")}
    return Baseline(
        problem_type, target, classes, groups, metrics, evaluate.best_model(metrics, problem_type, **defaults),
        small_table(spark, failed, {"model": "string", "error_type": "string", "message": "string"}),
        small_table(spark, details, {"test_size": "double", "cross_validation_enabled": "boolean"} | longs | lists),
        small_table(spark, tables, {"model": "string", "label": "string", "prediction": "string", "count": "long"}),
        models, fitted, train, test, warnings,
    )
