"""Cross-validation of least squares from sufficient statistics: one pass over the rows serves every fold.

Each task adds up, per fold, the products of its rows' numbers; the sums of a fold are a small matrix. The matrix of the training rows of
fold k is the total less fold k, so its fit is solved on the driver, and the squared error on fold k follows from fold k's own matrix.
A gap enters as 0 with an indicator beside it, so that the median of each fold's training rows can be put in afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugewell.functions import cells
from gaugewell.functions.small import small_table
from gaugewell.operators import stats
from gaugewell.operators.schema import columns_of

ROWS = 8_192


def _products(batches: Iterator[pa.RecordBatch], folds: int, width: int) -> Iterator[pa.RecordBatch]:
    """Sums of z z' per fold over the rows of a task, as cells (fold, i, j, x) of the upper triangle."""
    total = np.zeros((folds, width, width))
    for batch in batches:
        for first in range(0, len(batch), ROWS):
            part = batch.slice(first, ROWS)
            fold, z = part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(len(part), width)
            for k in np.unique(fold):
                rows = z[fold == k]
                total[k] += rows.T @ rows
    k, i, j = np.nonzero(np.broadcast_to(np.triu(np.ones((width, width), bool)), total.shape))
    yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in (k, i, j)], pa.array(total[k, i, j])], names=["fold", "i", "j", "x"])


def fold_products(df: DataFrame, z: Any, width: int, folds: int) -> np.ndarray:
    """(folds, width, width): sums of z z' for an array column z without nulls; `df` has a fold column from 0."""
    found = df.select(F.col("fold").cast("int"), z.alias("z")).mapInArrow(partial(_products, folds=folds, width=width), "fold int, i int, j int, x double")
    out = np.zeros((folds, width, width))
    for r in found.groupBy("fold", "i", "j").agg(F.sum("x").alias("x")).collect():  # one number per cell, whatever the tasks
        out[r["fold"], r["i"], r["j"]] = out[r["fold"], r["j"], r["i"]] = r["x"]
    return out


def least_squares(gram: np.ndarray) -> np.ndarray:
    """(intercept, coefficients) from the sums of products of (1, y, x); the smallest solution where features depend on each other."""
    n = gram[0, 0]
    mean = gram[0] / n
    spread = gram - n * np.outer(mean, mean)
    scale = np.sqrt(np.clip(np.diag(spread), 0, None))[2:]
    used = np.flatnonzero(scale > 1e-12 * np.sqrt(np.clip(np.diag(gram)[2:], 0, None)))
    beta = np.zeros(len(scale))
    if len(used):
        s = scale[used]
        beta[used] = np.linalg.lstsq(spread[2:, 2:][np.ix_(used, used)] / np.outer(s, s), spread[2:, 1][used] / s, rcond=1e-10)[0] / s
    return np.append(mean[1] - beta @ mean[2:], beta)


def linear_fold_scores(df: DataFrame, features: list[str], label: str, folds: int) -> list[float]:
    """Root mean squared error on each fold (0-based column `fold`) of least squares fitted on the others; empty folds have none.

    Gaps and infinities of a feature become its median over the training rows of that fold. Rows without a finite label are left out.
    """
    infos = {c.name: c for c in columns_of(df)}
    y = cells.finite(label, infos[label].dtype)
    x = {n: cells.finite(n, infos[n].dtype) for n in features}
    rows = df.where(y.isNotNull())
    seen = stats.reduce_cells(rows, {f"x{i}": x[n] for i, n in enumerate(features)} | {"y": y}, {"m": "avg(x)", "n": "count(x)", "rows": "count(1)"})
    if not seen:
        return []
    shift = [seen[f"x{i}"]["m"] or 0.0 for i in range(len(features))]
    gappy = [i for i in range(len(features)) if seen[f"x{i}"]["n"] < seen[f"x{i}"]["rows"]]
    fills: dict[str, list[float | None]] = {}
    if gappy:
        own = rows.select(*[F.when(F.col("fold") != k, x[features[i]]).alias(f"f{i}_{k}") for i in gappy for k in range(folds)])
        fills = stats.quantiles_of(own, own.columns, [0.5])
    z = F.array(F.lit(1.0), y - F.lit(seen["y"]["m"]), *[F.coalesce(x[n] - F.lit(shift[i]), F.lit(0.0)) for i, n in enumerate(features)],
                *[x[features[i]].isNull().cast("double") for i in gappy])
    products = fold_products(rows, z, 2 + len(features) + len(gappy), folds)
    whole, scores = products.sum(0), []
    for k in range(folds):
        place = np.eye(2 + len(features) + len(gappy))[:, :2 + len(features)]
        for j, i in enumerate(gappy):
            fill = fills[f"f{i}_{k}"][0]
            place[2 + len(features) + j, 2 + i] = (0.0 if fill is None else fill) - shift[i]
        inner, outer = (place.T @ g @ place for g in (whole - products[k], products[k]))
        if inner[0, 0] < 0.5 or outer[0, 0] < 0.5:
            continue
        fit = least_squares(inner)
        residual = np.concatenate([[-fit[0], 1.0], -fit[1:]])
        scores.append(float(np.sqrt(max(0.0, residual @ outer @ residual) / outer[0, 0])))
    return scores


def linear_cross_validation(df: DataFrame, features: list[str], label: str, folds: int) -> DataFrame:
    """One row (folds, cv_mean, cv_std): mean and population deviation of `linear_fold_scores`, rounded to four places."""
    scores = linear_fold_scores(df, features, label, folds)
    row = {"folds": len(scores), "cv_mean": round(float(np.mean(scores)), 4) if scores else None, "cv_std": round(float(np.std(scores)), 4) if scores else None}
    return small_table(df.sparkSession, [row], {"folds": "long", "cv_mean": "double", "cv_std": "double"})
