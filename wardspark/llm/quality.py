"""Quality: a linear-chain conditional random field labels every line good or bad.

Features of a line and of its two neighbours feed the field; its weights and transitions are learned from labelled
documents outside the held-out fold. Only documents are labelled: lines of good documents are good, lines of bad
ones start with the label of a line classifier and are labelled anew by the field after each round. The marginals
of forward-backward, averaged by line length, give the score of a document through a logistic curve.

Defined cases: null and empty texts are one empty line; repeated rows are scored each on their own; without
labelled rows of both classes every score is 1; extra columns are ignored.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm.common import arrow_map, table
from wardspark.llm.fitting import apply_logistic, labelled_sample, logistic, remainder, sigmoid

DIVISOR, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Bound of the labelled sample from which the field and the curve are learned.
FIT_ROWS = 3000
ROUNDS, STEPS = 2, 120

_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()|-]")
_DIGIT = re.compile(r"\d")
N_FEATURES = 12


def line_features(line: str, seen: bool) -> tuple[float, ...]:
    words = line.split()
    n, chars = len(words), max(1, len(line))
    if not n:
        return (1.0,) + (0.0,) * (N_FEATURES - 1)
    return (
        0.0,
        min(n, 40) / 40,
        min(len(line) / n, 20) / 20,
        len(set(words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n,
        min(line.count("!") / n, 1.0),
        min(line.count("|") / n, 1.0),
        min(len(_SYMBOL.findall(line)) / n, 3.0) / 3,
        len(_DIGIT.findall(line)) / chars,
        float(line.rstrip()[-1:] in ".!?"),
        float(seen),
    )


def split(text: str | None) -> list[str]:
    return (text or "").split("\n")


def matrix(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features with those of both neighbours, line lengths, and lines by document."""
    rows, lengths, counts = [], [], []
    for text in texts:
        lines, seen = split(text), set()
        for line in lines:
            rows.append(line_features(line, line in seen))
            lengths.append(len(line) + 1)
            seen.add(line)
        counts.append(len(lines))
    own, counts = np.array(rows, np.float32), np.array(counts)
    starts = np.cumsum(counts) - counts
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[starts], after[starts + counts - 1] = 0, 0
    return np.hstack([own, before, after]), np.array(lengths, float), counts


def marginals(emit: np.ndarray, move: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all documents at once, one step for each line number.

    emit: log weight of ``bad`` against ``good`` by line; move: 2 x 2 log weights. Gives the probability of ``bad``
    by line, and the expected number of each transition."""
    order = np.argsort(-counts, kind="stable")
    starts, counts = (np.cumsum(counts) - counts)[order], counts[order]
    both = np.column_stack([np.zeros_like(emit), emit])
    forward, backward = np.empty_like(both), np.zeros_like(both)
    live = [int(np.searchsorted(-counts, -t, side="left")) for t in range(int(counts[0]) + 1)]  # documents with > t lines
    forward[starts] = both[starts]
    for t in range(1, int(counts[0])):
        at = starts[: live[t]] + t
        forward[at] = both[at] + np.logaddexp(forward[at - 1][:, :1] + move[0], forward[at - 1][:, 1:] + move[1])
    expected = np.zeros((2, 2))
    for t in range(int(counts[0]) - 1, 0, -1):
        at = starts[: live[t]] + t
        later = both[at] + backward[at]
        backward[at - 1] = np.logaddexp(later[:, :1] + move[:, 0], later[:, 1:] + move[:, 1])
        joint = forward[at - 1][:, :, None] + move + later[:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    total = forward + backward
    return sigmoid(total[:, 1] - total[:, 0]), expected


@dataclass(frozen=True)
class Field:
    weights: np.ndarray
    move: np.ndarray
    curve: np.ndarray


def train_lines(x: np.ndarray, labels: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Conditional likelihood of line labels, climbed with Adam."""
    x1 = np.column_stack([x, np.ones(len(x), np.float32)])
    first = np.cumsum(counts) - counts
    inner = np.ones(len(x), bool)
    inner[first] = False
    seen = np.zeros((2, 2))
    to = np.flatnonzero(inner)
    np.add.at(seen, (labels[to - 1], labels[to]), 1)
    params = np.zeros(x1.shape[1] + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, move = params[:-4], params[-4:].reshape(2, 2)
        p, expected = marginals(x1 @ w, move, counts)
        slope = np.concatenate([x1.T @ (labels - p), (seen - expected).ravel()]) / len(x) - 1e-4 * params
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        params = params + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return params[:-4], params[-4:].reshape(2, 2)


def document_features(bad: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals, its logarithm, and the logarithm of the bad characters."""
    starts = np.cumsum(counts) - counts
    weight = np.add.reduceat(bad * lengths, starts)
    share = weight / np.add.reduceat(lengths, starts)
    return np.column_stack([share, np.log(share + 1e-4), np.log1p(weight)])


def learn(texts: list[str], good: np.ndarray) -> Field | None:
    if not len(good) or not 0 < good.mean() < 1:
        return None
    x, lengths, counts = matrix(texts)
    doc = np.repeat(np.arange(len(counts)), counts)
    bad_doc = good[doc] == 0
    w = logistic(x, bad_doc.astype(float), ridge=1.0)
    p = apply_logistic(x, w)
    for _ in range(ROUNDS):
        labels = (bad_doc & (p >= 0.5)).astype(int)
        top = np.zeros(len(counts))
        np.maximum.at(top, doc, p)
        labels[bad_doc & (p >= top[doc])] = 1  # a bad document has a bad line
        weights, move = train_lines(x, labels, counts)
        p, _ = marginals(np.column_stack([x, np.ones(len(x), np.float32)]) @ weights, move, counts)
    return Field(weights, move, logistic(document_features(p, lengths, counts), good))


def fit(spark: SparkSession, sf_dir: str, docs: DataFrame, rows: int = FIT_ROWS) -> Field | None:
    return learn(*labelled_sample(spark, sf_dir, docs, "quality", DIVISOR, HELD_OUT, rows))


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    def rows(x: dict) -> dict:
        if field is None or not x["text"]:
            return {"doc_id": x["doc_id"], "score": [1.0] * len(x["text"]), "bad_share": [None] * len(x["text"])}
        features, lengths, counts = matrix(x["text"])
        bad, _ = marginals(features @ field.weights[:-1] + field.weights[-1], field.move, counts)
        found = document_features(bad, lengths, counts)
        return {"doc_id": x["doc_id"], "score": apply_logistic(found, field.curve).tolist(), "bad_share": found[:, 0].tolist()}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, score double, bad_share double", rows)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, fit(spark, sf_dir, docs)).select(
        "doc_id",
        (remainder(DIVISOR) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "bad_share",
    )
