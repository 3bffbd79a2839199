"""Helpers of the trained classifiers: a bounded sample of labelled rows, and logistic regression on it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_logistic(x: np.ndarray, y: np.ndarray, shrink: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink * np.eye(len(w)), x.T @ (p - y) + shrink * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, most_rows: int, usable: str = "true") -> list[tuple[str, int]]:
    """Up to most_rows (text, 0 or 1) rows of each class that satisfy `usable`, a condition on the column id: those of smallest id hash."""
    label = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").where(usable)
    chosen = [label.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(most_rows) for k in (0, 1)]
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = source.join(F.broadcast(chosen[0].union(chosen[1])), "id").select("id", "text", "label").toPandas()  # at most 2 * most_rows rows
    rows = rows.sort_values(["id", "label"], kind="stable")
    return list(zip(rows["text"], rows["label"]))


def held_out(id_col: str):
    """Rows kept from all fitting: the remainder of crc32 of the id as text by 3 is 1."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1
