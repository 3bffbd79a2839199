"""Explanations: importances, linear and tree Shapley values and their summaries."""

from __future__ import annotations

import uuid
from typing import Any, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gaugewell.errors import AuditError
from gaugewell.functions.small import small_table
from gaugewell.operators import prep, split

SAMPLE_ROWS, TOP_FEATURES, LOCAL_ROWS, BACKGROUND_ROWS = 200, 20, 5, 50
STEP_ROWS = 4_000_000  # steps of walks that a task makes


def sample_rows(test: DataFrame, key: str | list[str] | None = None, n: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """At most n seeded rows, the usual input of a Shapley computation."""
    return split.sample_rows(test, n, key, seed)


def _slots(spark: SparkSession, names: list[str], values: list[float], kind: str) -> DataFrame:
    rows = [{"feature": n, "importance": float(v) if np.isfinite(v) else 0.0} for n, v in zip(names, values)]
    table = small_table(spark, rows, {"feature": "string", "importance": "double"})
    return table.withColumns({"absolute_importance": F.abs("importance"), "importance_type": F.lit(kind)})


def importance(model: PipelineModel, names: list[str], top: int = TOP_FEATURES) -> DataFrame:
    """Top features of the last stage: tree importances or coefficients (mean absolute over classes)."""
    last = model.stages[-1]
    spark = SparkSession.getActiveSession()
    if hasattr(last, "featureImportances"):
        table = _slots(spark, names, last.featureImportances.toArray(), "tree_feature_importance")
    elif hasattr(last, "coefficientMatrix"):
        c = last.coefficientMatrix.toArray()
        table = _slots(spark, names, c[0] if c.shape[0] == 1 else np.abs(c).mean(axis=0), "linear_coefficient")
    elif hasattr(last, "coefficients"):
        table = _slots(spark, names, last.coefficients.toArray(), "linear_coefficient")
    else:
        raise AuditError("The model has no built-in importance.")
    return table.orderBy(F.desc("absolute_importance"), "feature").limit(top)


def linear_shap(sample: DataFrame, weights: dict[int, list[float]], intercepts: dict[int, float], names: list[str]) -> tuple[DataFrame, dict[int, float]]:
    """(row_id, class_index, slot, feature, feature_value, phi) with phi = weight * (x - mean x), and base values.

    `sample` has row_id and features.
    """
    spark = sample.sparkSession
    cells = sample.select("row_id", F.posexplode(vector_to_array("features")).alias("slot", "x"))
    means = {r["slot"]: r["m"] for r in cells.groupBy("slot").agg(F.avg("x").alias("m")).collect()}  # one row per vector slot, found once
    rows = [{"class_index": k, "slot": i, "weight": float(w), "feature": names[i], "m": means[i]} for k, ws in weights.items() for i, w in enumerate(ws) if i in means]
    table = small_table(spark, rows, {"class_index": "int", "slot": "int", "weight": "double", "feature": "string", "m": "double"})
    phi = cells.join(F.broadcast(table), "slot").select(
        "row_id", "class_index", "slot", "feature", F.col("x").alias("feature_value"), (F.col("weight") * (F.col("x") - F.col("m"))).alias("phi"))
    shift = {r["class_index"]: r["s"] for r in table.groupBy("class_index").agg(F.sum(F.col("weight") * F.col("m")).alias("s")).collect()}
    return phi, {k: intercepts[k] + shift[k] for k in weights}


def _weights_of(last: Any) -> tuple[dict[int, list[float]], dict[int, float]]:
    if hasattr(last, "coefficientMatrix"):
        c, b = last.coefficientMatrix.toArray(), last.interceptVector.toArray()
        return {i: list(c[i]) for i in range(c.shape[0])}, {i: float(b[i]) for i in range(c.shape[0])}
    return {0: list(last.coefficients.toArray())}, {0: float(last.intercept)}


def _work_folder(spark: SparkSession) -> str:
    """Shared folder of the cluster (spark.checkpoint.dir). It must be set; a machine-local folder would not be seen by executors."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        raise AuditError("Set spark.checkpoint.dir to a folder that all executors share.")
    return f"{folder.rstrip('/')}/gaugewell-{uuid.uuid4().hex}"


def tree_nodes(model: Any, folder: str | None = None) -> DataFrame:
    """(treeID, id, slot, threshold, categories, left, right, cover, values): the trees as a table, never on the driver."""
    spark = SparkSession.getActiveSession()
    path = folder or _work_folder(spark)
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    node = F.col("nodeData")
    fields = data.schema["nodeData"].dataType.fieldNames()
    stats = node["impurityStats"]
    return data.select(
        "treeID", node["id"].alias("id"), node["split"]["featureIndex"].alias("slot"),
        node["split"]["leftCategoriesOrThreshold"].alias("rule"), node["split"]["numCategories"].alias("categories"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["prediction"].alias("prediction"),
        stats.alias("stats"), (node["rawCount"].cast("double") if "rawCount" in fields else F.lit(None).cast("double")).alias("raw_count"),
    )


def _leaf_paths(nodes: dict[int, Any], weigh) -> Iterator[tuple[int, list[tuple[int, Any, bool, float]]]]:
    """Every leaf with its path of (slot, split, goes_left, share of the cover)."""
    stack: list[tuple[int, list]] = [(0, [])]
    while stack:
        i, path = stack.pop()
        n = nodes[i]
        if n.left < 0:
            yield i, path
            continue
        cover = weigh(n)
        for child, goes_left in ((n.left, True), (n.right, False)):
            share = weigh(nodes[child]) / cover if cover else 0.5
            stack.append((child, path + [(n.slot, n, goes_left, share)]))


_LEAVES = "tree int, leaf int, slots array<int>, low array<double>, high array<double>, kinds array<array<double>>, shares array<double>, value array<double>"


def _paths_of_tree(pdf: pd.DataFrame, is_class: bool) -> pd.DataFrame:
    """Every leaf of a tree as the conditions on its path, one per slot: an interval (low, high] or the categories let through, and
    the share of the cover that goes on where the slot is unknown."""
    nodes = {n.id: n for n in pdf.itertuples()}

    def weigh(n):
        return float(np.sum(n.stats)) if is_class else float(n.stats[0])

    out = []
    for leaf, path in _leaf_paths(nodes, weigh):
        low, high, kinds, shares = {}, {}, {}, {}
        for slot, node, goes_left, share in path:
            shares[slot] = shares.get(slot, 1.0) * share
            if node.categories >= 0:
                left = {float(v) for v in node.rule}
                through = left if goes_left else {float(v) for v in range(node.categories)} - left
                kinds[slot] = kinds.get(slot, through) & through
            elif goes_left:
                high[slot] = min(high.get(slot, np.inf), float(node.rule[0]))
            else:
                low[slot] = max(low.get(slot, -np.inf), float(node.rule[0]))
        n, slots = nodes[leaf], list(shares)
        value = np.asarray(n.stats, dtype=float) / max(np.sum(n.stats), 1e-300) if is_class else np.asarray([n.prediction], dtype=float)
        out.append((int(pdf["treeID"].iloc[0]), leaf, slots, [low.get(s, -np.inf) for s in slots], [high.get(s, np.inf) for s in slots],
                    [sorted(kinds[s]) if s in kinds else None for s in slots], [shares[s] for s in slots], list(value)))
    return pd.DataFrame(out, columns=["tree", "leaf", "slots", "low", "high", "kinds", "shares", "value"])


def leaf_paths(model: Any, folder: str | None = None) -> DataFrame:
    """(tree, leaf, slots, low, high, kinds, shares, value): the leaves of a forest with the conditions that lead to them."""
    is_class = hasattr(model, "numClasses")

    def of_tree(pdf: pd.DataFrame) -> pd.DataFrame:
        return _paths_of_tree(pdf, is_class)

    return tree_nodes(model, folder).groupBy("treeID").applyInPandas(of_tree, _LEAVES)


def _leaf_phi(xs: np.ndarray, leaves: pd.DataFrame, outputs: int) -> np.ndarray:
    """(rows, slots, outputs): Shapley values of some leaves' parts of the forest's output.

    Each leaf is a product of per-slot factors: covered share when the slot is
    unknown, 0 or 1 when it is known. Its Shapley value is a weighted sum over
    subset sizes of that product, kept as a polynomial over all rows.
    """
    rows, width = xs.shape
    phi = np.zeros((rows, width, outputs))
    for leaf in leaves.itertuples():
        d = len(leaf.slots)
        known = []
        for slot, low, high, kinds in zip(leaf.slots, leaf.low, leaf.high, leaf.kinds):
            x = xs[:, slot]
            known.append(((x > low) & (x <= high) if kinds is None else np.isin(x, np.asarray(kinds, dtype=float))).astype(float))
        weights = np.asarray([1.0 / (d * _choose(d - 1, k)) for k in range(d)])
        for i in range(d):
            poly = np.zeros((rows, d))  # coefficient of t^k: subsets of size k of the other slots
            poly[:, 0] = 1.0
            for j in range(d):
                if j != i:
                    moved = np.zeros_like(poly)
                    moved[:, 1:] = poly[:, :-1] * known[j][:, None]
                    poly = poly * leaf.shares[j] + moved
            phi[:, leaf.slots[i], :] += ((known[i] - leaf.shares[i]) * (poly @ weights))[:, None] * np.asarray(leaf.value)[None, :]
    return phi


def _choose(n: int, k: int) -> float:
    out = 1.0
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return out


SHAP_ROWS, SHAP_LEAVES = 1_024, 4_096  # rows and leaves that a task brings together


def tree_shap(model: Any, sample: DataFrame, names: list[str], folder: str | None = None) -> tuple[DataFrame, dict[int, float]]:
    """(row_id, class_index, slot, feature, feature_value, phi) averaged over trees, and base values.

    The leaves are a table, joined to the rows in cells of bounded numbers of rows and leaves, so that forests and samples of any
    size stay distributed. `sample` has row_id and features.
    """
    leaves, outputs, n_trees = leaf_paths(model, folder), int(getattr(model, "numClasses", 1)), model.getNumTrees
    reach = F.aggregate("shares", F.lit(1.0), lambda a, b: a * b)
    totals = leaves.agg(F.count(F.lit(1)).alias("n"), *[F.sum(reach * F.get("value", F.lit(k))).alias(f"b{k}") for k in range(outputs)]).first()
    base = {k: (totals[f"b{k}"] or 0.0) / n_trees for k in range(outputs)}
    rows = sample.select("row_id", vector_to_array("features").alias("x"))
    row_parts, leaf_parts = max(1, -(-rows.count() // SHAP_ROWS)), max(1, -(-totals["n"] // SHAP_LEAVES))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"row_id": [], "slot": [], "class_index": [], "phi": []}).astype({"row_id": "int64", "slot": "int32", "class_index": "int32"})
        phi = _leaf_phi(np.asarray(left["x"].tolist(), dtype=float), right, outputs)
        r, s, k = np.nonzero(phi)
        return pd.DataFrame({"row_id": left["row_id"].to_numpy()[r], "slot": s.astype("int32"), "class_index": k.astype("int32"), "phi": phi[r, s, k]})

    rows = rows.withColumn("row_part", F.pmod(F.xxhash64("row_id"), F.lit(row_parts)).cast("int"))
    rows = rows.withColumn("leaf_part", F.explode(F.sequence(F.lit(0), F.lit(leaf_parts - 1))))
    parted = leaves.withColumn("leaf_part", F.pmod(F.xxhash64("tree", "leaf"), F.lit(leaf_parts)).cast("int"))
    parted = parted.withColumn("row_part", F.explode(F.sequence(F.lit(0), F.lit(row_parts - 1))))
    cells = rows.groupBy("row_part", "leaf_part").cogroup(parted.groupBy("row_part", "leaf_part")).applyInPandas(cell, "row_id long, slot int, class_index int, phi double")
    summed = cells.groupBy("row_id", "slot", "class_index").agg((F.sum("phi") / n_trees).alias("phi"))
    values = sample.select("row_id", F.posexplode(vector_to_array("features")).alias("slot", "feature_value"))
    full = values.withColumn("class_index", F.explode(F.sequence(F.lit(0), F.lit(outputs - 1))))
    out = full.join(summed, ["row_id", "slot", "class_index"], "left").select(
        "row_id", F.col("class_index").cast("int").alias("class_index"), "slot",
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("slot") + 1).alias("feature"), "feature_value",
        F.coalesce("phi", F.lit(0.0)).alias("phi"))
    return out, base


def reduce_classes(phi: DataFrame, n_outputs: int) -> DataFrame:
    """One value per row and slot: as it is for one output, mean absolute over classes for several (sign is lost)."""
    if n_outputs <= 1:
        return phi.drop("class_index")
    return phi.groupBy("row_id", "slot", "feature", "feature_value").agg(F.avg(F.abs("phi")).alias("phi"))


def global_summary(phi: DataFrame, top: int = TOP_FEATURES) -> DataFrame:
    """(position, feature, mean_abs_shap, mean_shap, direction), largest mean absolute value first."""
    table = phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"), F.avg("phi").alias("mean_shap"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_abs_shap"), "feature")  # one row per vector slot
    return table.withColumns({
        "direction": F.when(F.col("mean_shap") >= 0, "positive").otherwise("negative"),
        "position": F.row_number().over(order).cast("long"),
    }).where(F.col("position") <= top)


def contributors(phi: DataFrame, sign: int, top: int = TOP_FEATURES) -> DataFrame:
    """Features that push the output up (sign 1) or down (sign -1) on average."""
    table = phi.groupBy("feature").agg(F.avg("phi").alias("mean_shap")).where(F.col("mean_shap") * sign > 0)
    return table.orderBy(F.col("mean_shap") * -sign, "feature").limit(top)


def local_explanations(phi: DataFrame, rows: int = LOCAL_ROWS, top: int = TOP_FEATURES) -> DataFrame:
    """(row_id, list, position, feature, phi, feature_value): overall, positive and negative lists of the first rows."""
    first = phi.select("row_id").distinct().orderBy("row_id").limit(rows)
    some = phi.join(F.broadcast(first), "row_id")  # `rows` ids
    def ranked(df, kind, order):
        w = Window.partitionBy("row_id").orderBy(order, "feature")
        return df.withColumns({"list": F.lit(kind), "position": F.row_number().over(w).cast("long")}).where(F.col("position") <= top)
    parts = [
        ranked(some, "overall", F.desc(F.abs("phi"))), ranked(some.where("phi > 0"), "positive", F.desc("phi")),
        ranked(some.where("phi < 0"), "negative", F.asc("phi")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("row_id", "list", "position", "feature", "phi", "feature_value")


def agnostic_shap(
    predict, sample: DataFrame, columns: list[str], permutations: int = 8, seed: int = 42, background: int = BACKGROUND_ROWS
) -> DataFrame:
    """(row_id, feature, phi) for any model: permutation sampling against background rows of the sample.

    `predict(df)` adds a numeric `prediction`. The background is the `background` rows
    of smallest row_id and travels as a literal; each sample row walks from a
    background row to itself one column at a time, in a seeded order and its reverse.
    At least `permutations` pairs of walks are made, and as many from each background
    row, so for a linear model phi is its weight times (x - mean of the background).
    """
    rows = sample.orderBy("row_id").limit(background).select(*columns).collect()
    if not rows:
        raise AuditError("No background rows.")
    rng = np.random.default_rng(seed)
    orders, starts = [], []
    for pair in range(-(-permutations // len(rows)) * len(rows)):
        order = [int(i) for i in rng.permutation(len(columns))]
        orders += [order, order[::-1]]
        starts += [pair % len(rows)] * 2
    # The orders and background cells are literals: permutations x columns and at most `background` rows.
    listed = "array(" + ", ".join(f"array({', '.join(map(str, o))})" for o in orders) + ")"
    # Rows are dealt out by row_id before they are multiplied; all steps of a row stay in its task, so nothing is shuffled after that.
    parts = max(1, -(-sample.count() * len(orders) * (len(columns) + 1) // STEP_ROWS))
    dealt = sample.select("row_id", *columns).repartition(parts, "row_id")
    walks = dealt.select("*", F.explode(F.expr(f"sequence(0, {len(orders) - 1})")).alias("walk"))
    steps = walks.select("*", F.explode(F.expr(f"sequence(0, {len(columns)})")).alias("place"))
    steps = steps.withColumn("known", F.expr(f"slice(element_at({listed}, walk + 1), 1, place)"))
    steps = steps.withColumn("slot", F.expr("if(place > 0, element_at(known, -1), -1)"))
    pick = F.expr(f"element_at(array({', '.join(map(str, starts))}), walk + 1)")
    cells = []
    for i, c in enumerate(columns):
        kind = sample.schema[c].dataType
        other = F.element_at(F.array(*[F.lit(r[c]).cast(kind) for r in rows]), pick + 1)
        cells.append(F.when(F.array_contains("known", i), F.col(f"`{c}`")).otherwise(other).alias(c))
    hybrid = steps.select("row_id", "walk", "place", "slot", *cells)
    scored = predict(hybrid).select("row_id", "walk", "place", "slot", "prediction")
    step = F.col("prediction") - F.lag("prediction").over(Window.partitionBy("row_id", "walk").orderBy("place"))
    names = F.array(*[F.lit(c) for c in columns])
    return scored.withColumn("phi", step).where("slot >= 0").groupBy("row_id", F.element_at(names, F.col("slot") + 1).alias("feature")).agg(
        F.avg("phi").alias("phi"))


def explain_model(model: PipelineModel, test: DataFrame, key: str | list[str] | None = None, top: int = TOP_FEATURES, seed: int = 42, folder: str | None = None) -> dict[str, Any]:
    """Built-in importance, Shapley values of a bounded sample and their summaries for a fitted baseline."""
    sample = sample_rows(test, key, seed=seed)
    encoded = PipelineModel(stages=model.stages[:-1]).transform(sample)
    names = prep.feature_names(encoded)
    order = Window.partitionBy(F.lit(0)).orderBy(split.hash_key(sample, key, seed))  # at most SAMPLE_ROWS rows
    numbered = encoded.withColumn("row_id", F.row_number().over(order).cast("long")).select("row_id", "features").persist()
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        method = "tree_shap"
        phi, base = tree_shap(last, numbered, names, folder)
    else:
        method = "linear_shap"
        phi, base = linear_shap(numbered, *_weights_of(last), names)
    reduced = reduce_classes(phi, len(base)).persist()
    rows, ranking = numbered.count(), global_summary(reduced, top)
    notes = []
    if rows < 20:
        notes.append("Fewer than 20 sample rows: rankings are noisy.")
    if len(names) > 500:
        notes.append("More than 500 vector slots: one-hot importances are hard to read.")
    leader = ranking.where("position = 1").first()
    summary = [{"source": "shap", "method": method, "top_feature": leader["feature"] if leader else None, "features": len(names), "sample_rows": rows,
                "base_values": [float(base[k]) for k in sorted(base)], "warnings": notes}]
    return {
        "importance": importance(model, names, top), "values": phi, "reduced": reduced, "global": ranking,
        "positive": contributors(reduced, 1, top), "negative": contributors(reduced, -1, top), "local": local_explanations(reduced, top=top),
        "summary": small_table(test.sparkSession, summary, {"source": "string", "method": "string", "top_feature": "string", "features": "long",
                                                            "sample_rows": "long", "base_values": "doubles", "warnings": "strings"}),
        "base": base,
    }
