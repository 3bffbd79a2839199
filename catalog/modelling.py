"""Preparation, split, evaluation, model and explanation queries."""

from __future__ import annotations

import uuid

from catalog.registry import query, table, view, view_sql
from gaugewell.functions.small import small_table
from gaugewell.operators import evaluate, explain, folds, models, prep, split
from gaugewell.sources import sinks
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

_H = "md5(CAST({k} AS VARCHAR) || ':42'), CAST({k} AS VARCHAR)"
_DOCS = f"WITH v AS ({view_sql('labelled_documents')})"
_ORDERS = f"WITH v AS ({view_sql('forecast_orders')})"


@query(f"""WITH d AS ({view_sql('dirty_lineitem')}) SELECT count(*) AS rows, count(CASE WHEN isinf(l_extendedprice) THEN NULL ELSE l_extendedprice END) AS prices,
    count(CASE WHEN isnan(l_tax) THEN NULL ELSE l_tax END) AS taxes, count(l_discount) AS discounts FROM d WHERE l_returnflag IS NOT NULL""")
def clean_infinite(spark, sf_dir):
    out = prep.clean_target(view(spark, sf_dir, "dirty_lineitem"), "l_returnflag")
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count("l_extendedprice").alias("prices"), F.count("l_tax").alias("taxes"), F.count("l_discount").alias("discounts"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{g}' AS feature_group, {str(i).lower()} AS is_id_like, {str(d).lower()} AS name_suggests_date" for c, g, i, d in [
    ("doc_id", "id_like", True, False), ("text", "categorical", False, False), ("source", "categorical", False, False), ("n_chars", "numeric", False, False)]))
def feature_groups_documents(spark, sf_dir):
    return prep.feature_table(table(spark, sf_dir, "documents"), "lang").select("column", "feature_group", "is_id_like", "name_suggests_date")


@query(f"""WITH d AS ({view_sql('dirty_lineitem')}), u AS (SELECT count(DISTINCT row_ref) * 100.0 / count(*) AS p FROM d)
    SELECT 'row_ref' AS "column", CASE WHEN p >= 95 THEN 'id_like' ELSE 'categorical' END AS feature_group FROM u UNION ALL SELECT 'ship_day', 'datetime' UNION ALL SELECT 'is_final', 'categorical'
    UNION ALL SELECT 'l_shipdate', 'datetime' UNION ALL SELECT 'mixed_cell', 'categorical' UNION ALL SELECT 'l_tax', 'numeric'""")
def feature_groups(spark, sf_dir):
    df = view(spark, sf_dir, "dirty_lineitem").select("row_ref", "ship_day", "is_final", "l_shipdate", "mixed_cell", "l_tax", "l_returnflag")
    return prep.feature_table(df, "l_returnflag").select("column", "feature_group")


@query("""SELECT event_id, CAST(year(ts) AS DOUBLE) AS ts_year, CAST(month(ts) AS DOUBLE) AS ts_month, CAST(day(ts) AS DOUBLE) AS ts_day, CAST(isodow(ts) - 1 AS DOUBLE) AS ts_dayofweek,
    CAST(quarter(ts) AS DOUBLE) AS ts_quarter, CAST(day(ts) = 1 AS DOUBLE) AS ts_is_month_start, CAST(CAST(ts AS DATE) = last_day(ts) AS DOUBLE) AS ts_is_month_end FROM events""")
def calendar_features(spark, sf_dir):
    out = prep.calendar_features(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts"])
    return out.drop("ts")


def _scaled(c: str, v: str) -> str:
    return f"round((coalesce({v}, m_{c}) - avg(coalesce({v}, m_{c})) OVER ()) / stddev_pop(coalesce({v}, m_{c})) OVER (), 6) AS {c}"


_FIN = "CASE WHEN isinf(l_extendedprice) THEN NULL ELSE l_extendedprice END"


@query(f"""WITH d AS ({view_sql('dirty_lineitem')}), m AS (SELECT quantile_cont({_FIN}, 0.5) AS m_price, quantile_cont(l_discount, 0.5) AS m_discount FROM d),
    s AS (SELECT l_linenumber, {_scaled('price', _FIN)}, {_scaled('discount', 'l_discount')} FROM d, m)
    SELECT l_linenumber, count(*) AS rows, round(sum(price), 3) AS price, round(sum(discount), 3) AS discount FROM s GROUP BY l_linenumber""")
def impute_scale(spark, sf_dir):
    df = view(spark, sf_dir, "dirty_lineitem").select("l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))
    out = prep.impute_scale(df, ["price", "discount"]).withColumns({"price": F.round("price", 6), "discount": F.round("discount", 6)})
    return out.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("price"), 3).alias("price"), F.round(F.sum("discount"), 3).alias("discount"))


def _slots(c: str) -> str:
    return f"""SELECT '{c}' AS "column", CASE WHEN k <= 5 OR r < 5 THEN {c} ELSE 'infrequent' END AS value, CAST(sum(n) AS BIGINT) AS cnt FROM (
        SELECT {c}, n, row_number() OVER (ORDER BY n DESC, {c}) AS r, count(*) OVER () AS k FROM (SELECT {c}, count(*) AS n FROM part GROUP BY 1)) GROUP BY ALL"""


@query(f"{_slots('p_brand')} UNION ALL {_slots('p_type')}")
def one_hot_frequency(spark, sf_dir):
    """At most five slots per column; further brands share the infrequent slot."""
    return prep.categories(table(spark, sf_dir, "part"), ["p_brand", "p_type"], 5)


@query("""SELECT 'p_brand' AS "column", first(p_brand ORDER BY n DESC, p_brand) AS value FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)
    UNION ALL SELECT 'p_size', CAST(first(p_size ORDER BY n DESC, p_size) AS VARCHAR) FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1)""")
def fill_modes(spark, sf_dir):
    found = prep.modes(table(spark, sf_dir, "part"), ["p_brand", "p_size"])
    return small_table(spark, [{"column": k, "value": v} for k, v in found.items()], {"column": "string", "value": "string"})


@query(f"""{_DOCS}, c AS (SELECT toxic, count(*) AS n FROM v GROUP BY toxic) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS classes, min(n) AS smallest_class,
    CAST(ceil(sum(n) * 0.2::DOUBLE) AS BIGINT) AS test_rows, CAST(sum(n) - ceil(sum(n) * 0.2::DOUBLE) AS BIGINT) AS train_rows,
    count(*) >= 2 AND min(n) >= 2 AND ceil(sum(n) * 0.2::DOUBLE) >= count(*) AND sum(n) - ceil(sum(n) * 0.2::DOUBLE) >= count(*) AS can_stratify FROM c""")
def split_viability(spark, sf_dir):
    return split.stratify_check(view(spark, sf_dir, "labelled_documents"), "toxic")


def _split_sql(source: str, key: str, cls: str) -> str:
    return f"""{source}, n AS (SELECT {cls} AS c, count(*) AS k, sum(count(*)) OVER () AS total FROM v GROUP BY 1), t AS (SELECT *, CAST(ceil(total * 0.2::DOUBLE) AS BIGINT) AS want FROM n),
        q AS (SELECT *, CAST(k * want // total AS BIGINT) AS base, k * want % total AS rest FROM t),
        z AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, c) <= want - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM q)
        SELECT v.{key}, row_number() OVER (PARTITION BY z.c ORDER BY {_H.format(k='v.' + key)}) <= z.quota AS is_test FROM v JOIN z ON z.c = v.{cls}"""


@query(_split_sql(_DOCS, "doc_id", "toxic"))
def stratified_split(spark, sf_dir):
    return split.train_test_split(view(spark, sf_dir, "labelled_documents"), "doc_id", "toxic").select("doc_id", "is_test")


@query(_split_sql("WITH v AS (SELECT * FROM orders)", "o_orderkey", "o_orderpriority"))
def stratified_split_orders(spark, sf_dir):
    return split.train_test_split(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority").select("o_orderkey", "is_test")


@query(f"""SELECT o_orderkey, row_number() OVER (ORDER BY {_H.format(k='o_orderkey')}) <= ceil(count(*) OVER () * 0.2::DOUBLE) AS is_test FROM orders""")
def random_split(spark, sf_dir):
    return split.train_test_split(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "is_test")


@query(f"""SELECT o_orderkey, CAST(ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY {_H.format(k='o_orderkey')}) - 1 AS BIGINT) AS fold FROM orders""")
def cv_folds(spark, sf_dir):
    return split.assign_folds(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", 5).select("o_orderkey", "fold")


_GAPPY = "SELECT o_orderkey, o_orderstatus, actual_price, forecast_price, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey + 3 * forecast_price END AS drifting FROM ({view})"
_RMSE = "SELECT '{name}' AS features, k, sqrt(avg((y - ({prediction})) * (y - ({prediction})))) AS rmse FROM x JOIN fit USING (k) WHERE fold = k GROUP BY k"


@query(f"""WITH v AS ({_GAPPY.format(view=view_sql('forecast_orders'))}), f AS (SELECT *, ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY {_H.format(k='o_orderkey')}) - 1 AS fold FROM v),
    med AS (SELECT k, median(drifting) AS m FROM f JOIN (SELECT unnest(range(5)) AS k) ON fold <> k GROUP BY k),
    x AS (SELECT k, fold, CAST(actual_price AS DOUBLE) AS y, CAST(forecast_price AS DOUBLE) AS a, CAST(coalesce(drifting, m) AS DOUBLE) AS b FROM f CROSS JOIN med),
    fit AS (SELECT k, regr_slope(y, a) AS sa, regr_intercept(y, a) AS ia, regr_slope(y, b) AS sb, regr_intercept(y, b) AS ib, avg(y) AS my, avg(a) AS ma, avg(b) AS mb,
        (regr_sxy(y, a) * regr_sxx(y, b) - regr_sxy(y, b) * regr_sxy(a, b)) / (regr_sxx(y, a) * regr_sxx(y, b) - regr_sxy(a, b) * regr_sxy(a, b)) AS pa,
        (regr_sxy(y, b) * regr_sxx(y, a) - regr_sxy(y, a) * regr_sxy(a, b)) / (regr_sxx(y, a) * regr_sxx(y, b) - regr_sxy(a, b) * regr_sxy(a, b)) AS pb FROM x WHERE fold <> k GROUP BY k),
    e AS ({_RMSE.format(name='forecast_price', prediction='ia + sa * a')} UNION ALL {_RMSE.format(name='drifting', prediction='ib + sb * b')}
        UNION ALL {_RMSE.format(name='forecast_price,drifting', prediction='my + pa * (a - ma) + pb * (b - mb)')})
    SELECT features, count(*) AS folds, round(avg(rmse), 4) AS cv_mean, round(stddev_pop(rmse), 4) AS cv_std FROM e GROUP BY features""")
def linear_cross_validation(spark, sf_dir):
    """Five-fold least squares with medians of the training rows, for two features and both together."""
    view(spark, sf_dir, "forecast_orders").createOrReplaceTempView("priced_orders")
    folded = split.assign_folds(spark.sql(_GAPPY.format(view="SELECT * FROM priced_orders")), "o_orderkey", "o_orderstatus", 5)
    out = None
    for names in (["forecast_price"], ["drifting"], ["forecast_price", "drifting"]):
        part = folds.linear_cross_validation(folded, names, "actual_price", 5).select(F.lit(",".join(names)).alias("features"), "folds", "cv_mean", "cv_std")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT o_orderstatus, round(sum(count(*)) OVER ()::DOUBLE / (count(*) OVER () * count(*)), 6) AS weight FROM orders GROUP BY o_orderstatus""")
def class_weights(spark, sf_dir):
    return models.class_weights(table(spark, sf_dir, "orders"), "o_orderstatus").withColumn("weight", F.round("weight", 6))


@query("""WITH s AS (SELECT CAST(n_chars // 1000 AS VARCHAR) AS c, n_chars > 5500 AS is_test FROM documents)
    SELECT DISTINCT c AS "class" FROM s t WHERE is_test AND NOT EXISTS (SELECT 1 FROM s r WHERE NOT r.is_test AND r.c = t.c)""")
def classes_only_in_test(spark, sf_dir):
    df = table(spark, sf_dir, "documents").withColumn("class", F.expr("CAST(n_chars div 1000 AS STRING)"))
    return models.split_check(df.where("n_chars <= 5500"), df.where("n_chars > 5500"), "class")


@query(f"""WITH d AS ({view_sql('dirty_lineitem')}) SELECT count(*) FILTER (WHERE NOT isnan(l_extendedprice)) AS present, count(*) FILTER (WHERE NOT isinf(l_extendedprice)) AS numeric, count(*) FILTER (WHERE isinf(l_extendedprice)) AS infinite,
    true AS varies, 'none' AS error FROM d UNION ALL SELECT count(mixed_cell), count(TRY_CAST(mixed_cell AS DOUBLE)), 0, true, 'non_numeric_values' FROM d""")
def regression_targets(spark, sf_dir):
    df = view(spark, sf_dir, "dirty_lineitem")
    out = models.regression_target_check(df, "l_extendedprice").unionByName(models.regression_target_check(df, "mixed_cell"))
    return out.withColumn("error", F.coalesce("error", F.lit("none")))


_COUNTS = f"""{_DOCS}, s AS (SELECT cls, CAST(sum(sup) AS DOUBLE) AS sup, CAST(sum(pre) AS DOUBLE) AS pre, CAST(sum(hit) AS DOUBLE) AS hit FROM (
    SELECT quality AS cls, 1 AS sup, 0 AS pre, CASE WHEN quality = guess THEN 1 ELSE 0 END AS hit FROM v UNION ALL SELECT guess, 0, 1, 0 FROM v) GROUP BY cls),
    m AS (SELECT *, CASE WHEN sup > 0 THEN hit / sup ELSE 0 END AS rec, CASE WHEN pre > 0 THEN hit / pre ELSE 0 END AS prec FROM s), f AS (SELECT *, CASE WHEN rec + prec > 0 THEN 2 * rec * prec / (rec + prec) ELSE 0 END AS f1 FROM m)"""
_CLASS_METRICS = f"""{_COUNTS}, metrics AS (SELECT 'accuracy' AS metric, round(sum(hit) / sum(sup), 4) AS value FROM f UNION ALL SELECT 'balanced_accuracy', round(avg(CASE WHEN sup > 0 THEN rec END), 4) FROM f
    UNION ALL SELECT 'precision_weighted', round(sum(prec * sup) / sum(sup), 4) FROM f UNION ALL SELECT 'recall_weighted', round(sum(rec * sup) / sum(sup), 4) FROM f
    UNION ALL SELECT 'f1_score', round(sum(f1 * sup) / sum(sup), 4) FROM f UNION ALL SELECT 'f1_macro', round(avg(f1), 4) FROM f
    UNION ALL SELECT 'precision_binary', round(max(CASE WHEN cls = 1 THEN prec END), 4) FROM f UNION ALL SELECT 'recall_binary', round(max(CASE WHEN cls = 1 THEN rec END), 4) FROM f
    UNION ALL SELECT 'f1_binary', round(max(CASE WHEN cls = 1 THEN f1 END), 4) FROM f)"""


def _class_metrics(spark, sf_dir):
    return evaluate.classification_metrics(view(spark, sf_dir, "labelled_documents"), "binary_classification", "quality", "guess")


@query(f"{_CLASS_METRICS} SELECT * FROM metrics")
def class_metrics(spark, sf_dir):
    return _class_metrics(spark, sf_dir)


@query(f"{_DOCS} SELECT CAST(quality AS VARCHAR) AS label, CAST(guess AS VARCHAR) AS prediction, count(*) AS count FROM v GROUP BY ALL")
def confusion(spark, sf_dir):
    return evaluate.confusion(view(spark, sf_dir, "labelled_documents"), "quality", "guess")


@query(f"{_DOCS} SELECT CAST(quality AS VARCHAR) AS label, count(*) FILTER (WHERE guess = 0) AS \"0\", count(*) FILTER (WHERE guess = 1) AS \"1\" FROM v GROUP BY quality")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(view(spark, sf_dir, "labelled_documents"), ["0", "1"], "quality", "guess")


@query(f"""{_DOCS}, c AS (SELECT score, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS n FROM v GROUP BY score),
    w AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
    SELECT 'roc_auc' AS metric, round(sum(p * (below + n / 2.0))::DOUBLE / (sum(p) * sum(n)), 4) AS value FROM w""")
def roc_auc(spark, sf_dir):
    return evaluate.binary_auc(view(spark, sf_dir, "labelled_documents"), "score", "quality", "1")


@query("""WITH e AS (SELECT event_type AS grp, value, event_type = 'click' AS y FROM events UNION ALL SELECT 'all', value, event_type = 'purchase' FROM events),
    c AS (SELECT grp, value, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM e WHERE grp = 'all' GROUP BY ALL),
    w AS (SELECT grp, p, n, coalesce(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
    SELECT grp AS "group", CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, round(sum(p * (below + n / 2.0))::DOUBLE / (sum(p) * sum(n)), 4) AS auc FROM w GROUP BY grp""")
def roc_auc_events(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.lit("all").alias("group"), F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("positive"))
    return evaluate.roc_auc(df).withColumn("auc", F.round("auc", 4))


_REG = f"""{_ORDERS}, e AS (SELECT CAST(actual_price AS DOUBLE) AS y, CAST(forecast_price AS DOUBLE) AS p FROM v)"""
_REG_METRICS = f"""{_REG}, metrics AS (SELECT 'mae' AS metric, round(avg(abs(y - p)), 4) AS value FROM e UNION ALL SELECT 'mse', round(avg((y - p) * (y - p)), 2) FROM e UNION ALL SELECT 'rmse', round(sqrt(avg((y - p) * (y - p))), 4) FROM e
    UNION ALL SELECT 'r2_score', round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) FROM e UNION ALL SELECT 'mape', round(avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) * 100, 4) FROM e)"""


@query(f"{_REG_METRICS} SELECT * FROM metrics")
def regression_metrics(spark, sf_dir):
    """The squared error is shown to two places: its size leaves no room for four."""
    out = evaluate.regression_metrics(view(spark, sf_dir, "forecast_orders"), "actual_price", "forecast_price")
    return out.withColumn("value", F.when(F.col("metric") == "mse", F.round("value", 2)).otherwise(F.col("value")))


def _three_models(spark, sf_dir):
    """Metrics of three rule-based forecasts of one table."""
    df = view(spark, sf_dir, "forecast_orders")
    rules = {"priority": "forecast_price", "flat": "250000D", "status": "200000D + 50000D * length(o_orderstatus)"}
    out = None
    for i, (name, rule) in enumerate(rules.items()):
        m = evaluate.regression_metrics(df.withColumn("p", F.expr(rule)), "actual_price", "p")
        part = m.select(F.lit(i).cast("long").alias("position"), F.lit(name).alias("model"), "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out


_THREE = f"""{_ORDERS}, e AS (SELECT 0 AS position, 'priority' AS model, CAST(actual_price AS DOUBLE) AS y, CAST(forecast_price AS DOUBLE) AS p FROM v UNION ALL SELECT 1, 'flat', actual_price, 250000.0 FROM v
    UNION ALL SELECT 2, 'status', actual_price, 200000.0 + 50000 * length(o_orderstatus) FROM v), s AS (SELECT position, model, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae FROM e GROUP BY ALL)"""


@query(f"{_THREE} SELECT model, 'rmse' AS selection_metric, rmse AS score, false AS higher_is_better FROM s ORDER BY rmse, position LIMIT 1")
def best_model(spark, sf_dir):
    return evaluate.best_model(_three_models(spark, sf_dir), "regression")


@query(f"{_THREE} SELECT CAST(position AS BIGINT) AS position, model, rmse, mae FROM s")
def model_leaderboard(spark, sf_dir):
    return evaluate.leaderboard(_three_models(spark, sf_dir), ["rmse", "mae"])


# Smaller forests than the library default keep the rows-only queries short; they train on whole tables.
_FAST = models.Settings(trees=10, depth=5, max_iter=50)


def _classifier(spark, sf_dir, only=None):
    df = view(spark, sf_dir, "labelled_documents").select("doc_id", "lang", "source", "n_chars", "score", "toxic")
    return models.train_baselines(df, "toxic", "binary_classification", "doc_id", _FAST, only)


def _regressor(spark, sf_dir, only=None):
    return models.train_baselines(table(spark, sf_dir, "orders"), "o_totalprice", "regression", "o_orderkey", _FAST, only)


def _folder(spark) -> str | None:
    """The trees go to the shared folder that the session names; a session without one, as in tests, gets its own."""
    return None if spark.conf.get("spark.checkpoint.dir", None) else f"/tmp/checkpoints/trees-{uuid.uuid4().hex}"


@query()
def baseline_classification(spark, sf_dir):
    return _classifier(spark, sf_dir).metrics


@query()
def baseline_regression(spark, sf_dir):
    return _regressor(spark, sf_dir).metrics


def _encoded(b, key):
    sample = explain.sample_rows(b.test, key)
    return b.encoder.transform(sample).withColumn("row_id", F.col(key).cast("long"))


@query()
def tree_importance(spark, sf_dir):
    b = _classifier(spark, sf_dir, ["Random Forest Classifier"])
    return explain.importance(b.models["Random Forest Classifier"], prep.feature_names(_encoded(b, "doc_id")))


@query()
def linear_shap(spark, sf_dir):
    b = _regressor(spark, sf_dir, ["Linear Regression"])
    encoded = _encoded(b, "o_orderkey")
    phi, _ = explain.linear_shap(encoded, *explain._weights_of(b.models["Linear Regression"].stages[-1]), prep.feature_names(encoded))
    return explain.global_summary(phi)


@query()
def tree_shap(spark, sf_dir):
    b = _classifier(spark, sf_dir, ["Random Forest Classifier"])
    encoded = _encoded(b, "doc_id")
    phi, base = explain.tree_shap(b.models["Random Forest Classifier"].stages[-1], encoded, prep.feature_names(encoded), _folder(spark))
    return explain.global_summary(explain.reduce_classes(phi, len(base)))


@query(f"""SELECT row_id, class_index, true AS adds_up FROM (SELECT doc_id AS row_id FROM ({_split_sql(_DOCS, "doc_id", "toxic")}) WHERE is_test), (SELECT CAST(unnest([0, 1]) AS INTEGER) AS class_index)""")
def tree_shap_adds_up(spark, sf_dir):
    """For every test row and class, the Shapley values of the forest and its base value add up to the predicted probability."""
    b = _classifier(spark, sf_dir, ["Random Forest Classifier"])
    encoded = b.encoder.transform(b.test).withColumn("row_id", F.col("doc_id").cast("long"))
    forest = b.models["Random Forest Classifier"].stages[-1]
    phi, base = explain.tree_shap(forest, encoded, prep.feature_names(encoded), _folder(spark))
    chance = forest.transform(encoded).select("row_id", F.posexplode(vector_to_array("probability")).alias("class_index", "p"))
    total = phi.groupBy("row_id", "class_index").agg(F.sum("phi").alias("s")).join(chance, ["row_id", "class_index"], "full")
    start = F.element_at(F.array(*[F.lit(base[k]) for k in sorted(base)]), F.col("class_index") + 1)
    return total.select("row_id", "class_index", F.coalesce(F.abs(F.col("s") + start - F.col("p")) < 1e-9, F.lit(False)).alias("adds_up"))


_LINEAR = f"""WITH v AS ({_GAPPY.format(view=view_sql('forecast_orders'))}),
    s AS (SELECT *, row_number() OVER (ORDER BY {_H.format(k='o_orderkey')}) <= ceil(count(*) OVER () * 0.2::DOUBLE) AS is_test FROM v),
    x AS (SELECT o_orderkey, is_test, CAST(actual_price AS DOUBLE) AS y, CAST(forecast_price AS DOUBLE) AS a, CAST(coalesce(drifting, (SELECT median(drifting) FROM s WHERE NOT is_test)) AS DOUBLE) AS b FROM s),
    fit AS (SELECT (regr_sxy(y, a) * regr_sxx(y, b) - regr_sxy(y, b) * regr_sxy(a, b)) / (regr_sxx(y, a) * regr_sxx(y, b) - regr_sxy(a, b) * regr_sxy(a, b)) AS pa,
        (regr_sxy(y, b) * regr_sxx(y, a) - regr_sxy(y, a) * regr_sxy(a, b)) / (regr_sxx(y, a) * regr_sxx(y, b) - regr_sxy(a, b) * regr_sxy(a, b)) AS pb,
        avg(y) AS my, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS da, stddev_pop(b) AS db FROM x WHERE NOT is_test),
    mid AS (SELECT avg(a) AS ta, avg(b) AS tb FROM x WHERE is_test),
    phi AS (SELECT o_orderkey AS row_id, 'numeric__forecast_price' AS feature, pa * (a - ta) AS phi FROM x, fit, mid WHERE is_test
        UNION ALL SELECT o_orderkey, 'numeric__drifting', pb * (b - tb) FROM x, fit, mid WHERE is_test)"""


def _linear(spark, sf_dir):
    """A linear model of the order price on two numbers, fitted on the training rows, and its Shapley values on all test rows."""
    view(spark, sf_dir, "forecast_orders").createOrReplaceTempView("priced_orders")
    sided = split.train_test_split(spark.sql(_GAPPY.format(view="SELECT * FROM priced_orders")), "o_orderkey").withColumn("label", F.col("actual_price").cast("double"))
    encoder = prep.FeatureEncoder(prep.FeatureGroups(numeric=["forecast_price", "drifting"])).fit(sided.where("NOT is_test"))
    model = PipelineModel(stages=[*encoder.stages, models.baseline_estimators("regression", models.Settings(), 0)["Linear Regression"].fit(encoder.transform(sided.where("NOT is_test")))])
    encoded = encoder.transform(sided.where("is_test")).withColumn("row_id", F.col("o_orderkey").cast("long"))
    names = prep.feature_names(encoded)
    phi, base = explain.linear_shap(encoded, *explain._weights_of(model.stages[-1]), names)
    return model, names, explain.reduce_classes(phi, len(base)), base


@query(f"""{_LINEAR} SELECT row_id, feature, round(phi, 3) AS phi FROM phi""")
def linear_contributions(spark, sf_dir):
    return _linear(spark, sf_dir)[2].select("row_id", "feature", F.round("phi", 3).alias("phi"))


@query(f"""{_LINEAR}, g AS (SELECT feature, avg(abs(phi)) AS ma, avg(phi) AS m FROM phi GROUP BY feature)
    SELECT row_number() OVER (ORDER BY ma DESC, feature) AS position, feature, round(ma, 3) AS mean_abs_shap FROM g""")
def linear_ranking(spark, sf_dir):
    return explain.global_summary(_linear(spark, sf_dir)[2]).select("position", "feature", F.round("mean_abs_shap", 3).alias("mean_abs_shap"))


@query(f"""{_LINEAR}, chosen AS (SELECT * FROM phi WHERE row_id IN (SELECT DISTINCT row_id FROM phi ORDER BY row_id LIMIT 5)),
    lists AS (SELECT row_id, 'overall' AS list, feature, phi, abs(phi) AS size FROM chosen UNION ALL SELECT row_id, 'positive', feature, phi, phi FROM chosen WHERE phi > 0
        UNION ALL SELECT row_id, 'negative', feature, phi, -phi FROM chosen WHERE phi < 0)
    SELECT row_id, list, row_number() OVER (PARTITION BY row_id, list ORDER BY size DESC, feature) AS position, feature, round(phi, 3) AS phi FROM lists""")
def linear_local_lists(spark, sf_dir):
    return explain.local_explanations(_linear(spark, sf_dir)[2]).select("row_id", "list", "position", "feature", F.round("phi", 3).alias("phi"))


@query(f"""{_LINEAR}, c AS (SELECT 'numeric__forecast_price' AS feature, pa * da AS w FROM fit UNION ALL SELECT 'numeric__drifting', pb * db FROM fit)
    SELECT feature, round(w, 3) AS importance, round(abs(w), 3) AS absolute_importance, 'linear_coefficient' AS importance_type FROM c
    UNION ALL SELECT 'base value', round(my + pa * (ta - ma) + pb * (tb - mb), 3), NULL, 'base_value' FROM fit, mid""")
def linear_importance(spark, sf_dir):
    """Coefficients of the scaled features, and the base value: the mean prediction over the explained rows."""
    model, names, _, base = _linear(spark, sf_dir)
    found = explain.importance(model, names).select("feature", *[F.round(c, 3).alias(c) for c in ("importance", "absolute_importance")], "importance_type")
    return found.unionByName(small_table(spark, [{"feature": "base value", "importance": round(base[0], 3), "absolute_importance": None, "importance_type": "base_value"}],
                                         {"feature": "string", "importance": "double", "absolute_importance": "double", "importance_type": "string"}))


@query("""WITH b AS (SELECT avg(c_acctbal) AS ab, avg(c_nationkey) AS an, avg(c_custkey) AS ac FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 50))
    SELECT c_custkey AS row_id, feature, round(phi, 3) AS phi FROM (SELECT c_custkey, 'c_acctbal' AS feature, 2.5::DOUBLE * (c_acctbal - ab) AS phi FROM customer, b
    UNION ALL SELECT c_custkey, 'c_nationkey', -4.0::DOUBLE * (c_nationkey - an) FROM customer, b UNION ALL SELECT c_custkey, 'code', 0.3::DOUBLE * (c_custkey - ac) FROM customer, b)""")
def agnostic_contributions(spark, sf_dir):
    """Model-agnostic Shapley values of a linear prediction, which have a closed form, for every customer."""
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("row_id"), F.col("c_acctbal").cast("double").alias("c_acctbal"),
                                                  F.col("c_nationkey").cast("double").alias("c_nationkey"), F.col("c_custkey").cast("double").alias("code"))
    out = explain.agnostic_shap(lambda d: d.withColumn("prediction", F.expr("2.5D * c_acctbal - 4.0D * c_nationkey + 0.3D * code + 7")), df, ["c_acctbal", "c_nationkey", "code"])
    return out.withColumn("phi", F.round("phi", 3))


@query(f"""{_LINEAR}, e AS (SELECT y, my + pa * (a - ma) + pb * (b - mb) AS p FROM x, fit WHERE is_test)
    SELECT 'rmse' AS key, round(sqrt(avg((y - p) * (y - p))), 3) AS value, CAST(1 AS BIGINT) AS logged FROM e UNION ALL SELECT 'mae', round(avg(abs(y - p)), 3), 1 FROM e""")
def run_log_twice(spark, sf_dir):
    """A linear baseline logged twice under one run id: its errors on the test rows are there once."""
    view(spark, sf_dir, "forecast_orders").createOrReplaceTempView("priced_orders")
    df = spark.sql(_GAPPY.format(view="SELECT * FROM priced_orders")).drop("o_orderstatus").withColumn("o_orderkey", F.col("o_orderkey").cast("string"))  # text that differs in every row is no feature
    found = models.train_baselines(df, "actual_price", "regression", "o_orderkey", models.Settings(cross_validate=False), ["Linear Regression"])
    path = (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints").rstrip("/") + f"/log-{uuid.uuid4().hex}"
    for _ in range(2):
        sinks.append_run(found, path, "orders", save_model=False)
    metrics = sinks.read_runs(spark, path)["metrics"].where("run_id = 'orders-0' AND key IN ('rmse', 'mae')")
    return metrics.groupBy("key").agg(F.round(F.max("value"), 3).alias("value"), F.count(F.lit(1)).alias("logged"))


_ENCODED = """SELECT *, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_totalprice END AS price, 5 AS same,
    CASE WHEN is_test AND o_orderkey % 5 = 0 THEN 'NEW' WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM sided_orders"""
_PARTS = {"year": "year(o_orderdate)", "month": "month(o_orderdate)", "day": "day(o_orderdate)", "dayofweek": "isodow(o_orderdate) - 1", "quarter": "quarter(o_orderdate)",
          "is_month_start": "(day(o_orderdate) = 1)", "is_month_end": "(CAST(o_orderdate AS DATE) = last_day(o_orderdate))"}


def _part_cells() -> str:
    return " UNION ALL ".join(
        f"SELECT o_orderkey, 'datetime__o_orderdate_{p}', CAST({e} AS DOUBLE) / (SELECT CASE WHEN stddev_pop(CAST({e} AS DOUBLE)) = 0 THEN 1 ELSE stddev_pop(CAST({e} AS DOUBLE)) END FROM f WHERE NOT is_test) FROM t"
        for p, e in _PARTS.items())


@query(f"""WITH sided_orders AS (SELECT *, row_number() OVER (ORDER BY {_H.format(k='o_orderkey')}) <= ceil(count(*) OVER () * 0.2::DOUBLE) AS is_test FROM orders),
    f AS ({_ENCODED}), t AS (SELECT * FROM f WHERE is_test), n AS (SELECT *, CAST(coalesce(price, (SELECT median(price) FROM f WHERE NOT is_test)) AS DOUBLE) AS filled FROM f),
    l AS (SELECT avg(filled) AS m, stddev_pop(filled) AS s FROM n WHERE NOT is_test), mode AS (SELECT priority FROM f WHERE NOT is_test AND priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    c AS (SELECT o_orderkey, 'numeric__price' AS slot, (filled - m) / s AS value FROM n, l WHERE is_test UNION ALL {_part_cells()}
        UNION ALL SELECT o_orderkey, 'categorical__priority_' || coalesce(priority, (SELECT priority FROM mode)), 1 FROM t WHERE priority IS NULL OR priority <> 'NEW')
    SELECT o_orderkey AS row_id, slot, round(value, 5) AS value FROM c WHERE value <> 0""")
def sparse_encoding(spark, sf_dir):
    """Orders encoded as (row, slot, value): learned on the training rows, applied to the others, with a category unseen in training."""
    split.train_test_split(table(spark, sf_dir, "orders"), "o_orderkey").createOrReplaceTempView("sided_orders")
    df = spark.sql(_ENCODED)
    groups = prep.FeatureGroups(numeric=["price", "same"], categorical=["priority"], datetime=["o_orderdate"])
    found = prep.sparse_cells(df.where("is_test"), "o_orderkey", prep.fit_sparse(df.where("NOT is_test"), groups))
    return found.select("row_id", "slot", F.round("value", 5).alias("value"))
