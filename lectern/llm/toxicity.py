"""Toxicity: non-negative positive-unlabelled learning of a linear classifier in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import MEMOS, batch, blocks, map_arrow, texts
from lectern.llm.features import BITS, crc_fold, sampled_vectors
from lectern.llm.words import MEMO_WORDS

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: The class prior where the labels do not tell it.
PRIOR = 0.1
#: Bounds of the training sample: confirmed toxic documents, and documents whose label is hidden.
POSITIVE_ROWS, UNLABELLED_ROWS = 4096, 8192
#: A word is a feature if it is so many standard errors commoner among the positives than the prior explains.
EVIDENCE = 3.0
BLOCK_BYTES = 8 << 20
_WORD = re.compile(r"\w+")


@dataclass
class Model:
    weights: np.ndarray
    bias: float


class _Places(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) >> (64 - BITS)
        return h


_PLACES = _Places()
MEMOS[__name__] = _PLACES.clear


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed lower-cased words and their log counts."""
    places = np.array(list(map(_PLACES.__getitem__, _WORD.findall(text.lower()))), np.int64)
    index, count = np.unique(places, return_counts=True)
    return index, np.log1p(count)


def _stacked(vectors: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(vectors)), [len(i) for i, _ in vectors])
    return rows, np.concatenate([i for i, _ in vectors]), np.concatenate([v for _, v in vectors])


def nnpu(positive: list, unlabelled: list, prior: float, epochs: int = 60, share: int = 16, rate: float = 0.02, slack: float = 0.0, l2: float = 1e-4, seed: int = 5, size: int = 1 << BITS) -> Model:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss by Adam on mini-batches.

    Where the second part falls below ``-slack`` a step goes the other way on it, so that it is not
    driven negative by fitting the unlabelled positives as negatives. Without positives or
    unlabelled texts the weights stay 0 and the bias is that of the prior.
    """
    n = size
    w, bias = np.zeros(n), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(w, bias)
    m, v, mb, vb, step = np.zeros(n), np.zeros(n), 0.0, 0.0, 0
    rng = np.random.default_rng(seed)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for _ in range(epochs):
        parts = zip(np.array_split(rng.permutation(len(positive)), share), np.array_split(rng.permutation(len(unlabelled)), share), strict=True)
        for p_ids, u_ids in parts:
            if not len(p_ids) or not len(u_ids):
                continue
            rows, index, value = _stacked([positive[i] for i in p_ids] + [unlabelled[i] for i in u_ids])
            k = len(p_ids)
            margin = np.bincount(rows, w[index] * value, k + len(u_ids)) + bias
            s = sigmoid(margin)
            loss_neg = np.logaddexp(0, margin)
            rest = loss_neg[k:].mean() - prior * loss_neg[:k].mean()
            # d/dmargin of log(1 + e^-m) is s - 1, of log(1 + e^m) it is s.
            grad_rest = np.concatenate([np.full(k, -prior / k), np.full(len(u_ids), 1 / len(u_ids))]) * s
            grad = -grad_rest if rest < -slack else grad_rest.copy()
            if rest >= -slack:
                grad[:k] += prior / k * (s[:k] - 1)
            g = np.bincount(index, grad[rows] * value, n) + l2 * w
            gb = grad.sum()
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            a, c = 1 - 0.9**step, 1 - 0.999**step
            w -= rate * (m / a) / (np.sqrt(v / c) + 1e-8)
            bias -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return Model(w, bias)


def telling_words(positive: list, unlabelled: list, prior: float, evidence: float = EVIDENCE) -> np.ndarray:
    """Places of the words whose share among the positives exceeds that among the negatives by ``evidence`` errors.

    The share among the negatives follows from the class prior: unlabelled = prior * positive + (1 - prior) * negative.
    """
    shares = []
    for some in (positive, unlabelled):
        found = np.zeros(1 << BITS)
        for index, _ in some:
            found[index] += 1
        shares.append((found + 0.5) / (len(some) + 1))
    p, u = shares
    n = np.clip((u - prior * p) / (1 - prior), 0.5 / (len(unlabelled) + 1), 1)
    error = np.sqrt(p * (1 - p) / max(1, len(positive)) + n * (1 - n) / max(1, len(unlabelled)))
    return np.flatnonzero((p - n) > evidence * error)


def train_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> Model:
    """Fit on whole texts: at most ``POSITIVE_ROWS`` confirmed toxic documents and ``UNLABELLED_ROWS`` documents whose label is hidden.

    Both are samples of the labelled rows outside the held-out fold, of which nothing is read. The
    class prior is the share of toxic documents among the labelled ones. The risk's own bias makes
    the score a probability under the prior, by which few texts reach ``threshold`` (on held-out
    rows of 10,000 documents 39 of 144 toxic ones); so at the end the bias is moved until the share
    of the unlabelled sample that scores ``threshold`` or more is the prior, or less where that would
    take in texts with under a quarter of the usual evidence of a positive. Without positives the
    model is the prior alone. Null labels and ids are left out; a document with several labels counts
    as its largest, one with several texts by its greatest.
    """
    docs = texts(docs)
    inside = crc_fold("doc_id", folds) != held_out
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(inside).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows, toxic = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    prior = min(0.9, max(1e-3, (toxic or 0) / rows)) if rows else PRIOR
    positive = sampled_vectors(docs, known.where("label = 1"), vector, POSITIVE_ROWS) if toxic else []
    unlabelled = sampled_vectors(docs, known, vector, UNLABELLED_ROWS) if rows else []
    keep = telling_words(positive, unlabelled, prior) if positive and unlabelled else np.zeros(0, np.int64)
    number = np.full(1 << BITS, -1)
    number[keep] = np.arange(len(keep))
    narrow = lambda some: [(number[i][number[i] >= 0], v[number[i] >= 0]) for i, v in some]
    u = narrow(unlabelled)
    model = nnpu(narrow(positive), u, prior, size=max(1, len(keep)))
    weights = np.zeros(1 << BITS)
    weights[keep] = model.weights[: len(keep)]
    if len(keep):
        margin = lambda some: np.array([model.weights[i] @ v for i, v in some])
        least = max(np.quantile(margin(u), 1 - prior), 0.25 * np.median(margin(narrow(positive))))
        model.bias = float(np.log(threshold / (1 - threshold)) - least)
    return Model(weights, model.bias)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD, folds: int = FOLDS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``; the score sees nothing but the text.

    Null and empty texts get the score of the bias alone. A null id belongs to the fold of the empty
    text. Repeated rows give repeated rows, an empty input none; other columns are ignored. Nothing
    is shuffled; the broadcast weights have a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for b in blocks(batches, "text", BLOCK_BYTES):
            margins = []
            for text in b.column(1).to_pylist():
                index, value = vector(text)
                margins.append(bias + float(w[index] @ value))
            yield batch(doc_id=b.column(0), score=pa.array(1 / (1 + np.exp(-np.clip(np.array(margins), -30, 30)))))

    rows = map_arrow(texts(docs, id_col, text_col), score, "doc_id long, score double")
    return rows.select("doc_id", (crc_fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
