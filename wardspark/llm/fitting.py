"""Bounded labelled samples and a small logistic regression, shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm.common import first_rows, table


def remainder(divisor: int):
    """crc32 of the decimal doc_id modulo ``divisor``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(divisor))


def labelled_sample(
    spark: SparkSession, sf_dir: str, docs: DataFrame, label: str, divisor: int, out: int, rows: int
) -> tuple[list[str], np.ndarray]:
    """Whole texts and labels of at most ``rows`` labelled documents outside the held-out fold, chosen by hash of id. Of
    rows that repeat a doc_id the smallest text counts, so that no more than ``rows`` texts come to the driver."""
    labels = table(spark, sf_dir, "labels", "doc_id", label).where(
        F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(divisor) != out)
    )
    chosen = first_rows(labels.groupBy("doc_id").agg(F.max(label).alias(label)), "doc_id", rows)
    one = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id")
    got = one.agg(F.min("text").alias("text"), F.max(label).alias(label)).orderBy("doc_id").toArrow()
    return [t or "" for t in got["text"].to_pylist()], got[label].to_numpy().astype(float)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method with a ridge penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def apply_logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])
