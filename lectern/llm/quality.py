"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.features import BITS, SAMPLE_ROWS, crc_fold, sampled_vectors, scored, texts, vector

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, importance: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.001, l2: float = 0.1, epochs: int = 3, seed: int = 11) -> Model:
    """FTRL-proximal with a rate of its own for each weight; the last weight of the state is the bias (without l1).

    Without examples every weight is 0, so every score is one half.
    """
    n = 1 << BITS
    z, g2 = np.zeros(n + 1), np.zeros(n + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        penalty = np.where(i == n, 0.0, l1)
        zi = z[i]
        return np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(g2[i])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(vectors)):
            index, value = vectors[k]
            index, value = np.append(index, n), np.append(value, 1.0)
            w = weights(index)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
            g = importance[k] * (p - labels[k]) * value
            sigma = (np.sqrt(g2[index] + g * g) - np.sqrt(g2[index])) / alpha
            z[index] += g - sigma * w
            g2[index] += g * g
    every = weights(np.arange(n + 1))
    return Model(every[:n], float(every[n]))


def _vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    return vector(text, True)


def train_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on whole texts of at most ``rows`` documents of either label, none of the held-out fold.

    Documents of a label stand for all labelled documents of that label: they are weighted by how
    many there are (both labels together have mean weight 1). A document with several labels counts
    as its largest, one with several texts by its greatest; null labels and null ids are left out.
    Without labels or documents the weights are 0.
    """
    docs = texts(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(crc_fold("doc_id", folds) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    total = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    vectors, y, weight = [], [], []
    for label in (0, 1):
        found = sampled_vectors(docs, known.where(F.col("label") == label), _vector, rows) if total.get(label) else []
        vectors += found
        y += [label] * len(found)
        weight += [total.get(label, 0) / max(1, len(found))] * len(found)
    w = np.array(weight)
    return ftrl(vectors, np.array(y), w / w.mean() if len(w) else w)


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD, folds: int = FOLDS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``; the score sees nothing but the text.

    Null and empty texts have no n-grams and get the score of the bias alone. A null id belongs to
    the fold of the empty text. Repeated rows give repeated rows, an empty input none; other columns
    are ignored. Nothing is shuffled.
    """
    rows = scored(docs, model.weights, model.bias, True, id_col, text_col)
    return rows.select("doc_id", (crc_fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
