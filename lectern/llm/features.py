"""Hashed word n-grams of whole texts as sparse vectors, and bounded labelled samples for training."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import MEMOS, batch, binaries, blocks, map_arrow, texts
from lectern.llm.words import MEMO_WORDS, mix

#: log2 of the number of weights.
BITS = 20
BLOCK_BYTES = 4 << 20
#: Bound of the training sample: labelled documents of one class.
SAMPLE_ROWS = 2048
_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: A word's form counts 1 to 8 letters apart; the longest of a symbol run counts 4 signs.
_LETTERS, _SIGNS = 8, 4


def _form(word: str) -> str:
    if not word[0].isalnum():
        return word[:_SIGNS]
    if word[0].isdigit():
        return "0"
    case = "A" if len(word) > 1 and word.isupper() else "T" if word[0].isupper() else "a"
    return case + str(min(len(word), _LETTERS))


class _Numbers(dict):
    """Word to its place in two growing arrays: hash of the lower-cased word, and hash of its form."""

    def __init__(self) -> None:
        super().__init__()
        self.word, self.form = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint64)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        if n == len(self.word):
            self.word, self.form = (np.concatenate([x, np.zeros_like(x)]) for x in (self.word, self.form))
        self.word[n] = xxhash.xxh3_64_intdigest(word.lower())
        self.form[n] = xxhash.xxh3_64_intdigest(_form(word), seed=1)
        return n


_NUMBERS = _Numbers()


def _forget() -> None:
    global _NUMBERS
    _NUMBERS = _Numbers()


MEMOS[__name__] = _forget


def _gram(*parts: np.ndarray, kind: int) -> np.ndarray:
    h = np.full(len(parts[0]), kind, np.uint64)
    for p in parts:
        h = h * np.uint64(0x9E3779B97F4A7C15) + p
    return (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)


def vector(text: str, forms: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values. Words are runs of letters and digits, or of signs; values are log counts, scaled to length 1.

    Always lower-cased words and pairs of them; with ``forms`` also pairs and triples of word forms
    (case, length, signs), and of whether neighbours are the same word.
    """
    if len(_NUMBERS) > MEMO_WORDS:
        _forget()
    tokens = _TOKEN.findall(text)
    at = np.fromiter(map(_NUMBERS.__getitem__, tokens), np.int64, len(tokens))
    w = _NUMBERS.word[at]
    grams = [_gram(w, kind=1), _gram(w[:-1], w[1:], kind=2)]
    if forms:
        f, same = _NUMBERS.form[at], np.zeros(len(w), np.uint64)
        same[1:] = w[1:] == w[:-1]
        f2 = f + same
        grams += [_gram(f2[:-1], f2[1:], kind=3), _gram(f2[:-2], f2[1:-1], f2[2:], kind=4), _gram(same[1:], kind=5)]
    index, count = np.unique(np.concatenate(grams), return_counts=True)
    value = np.log1p(count)
    return index, value / max(1e-9, float(np.sqrt(value @ value)))


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def sampled_vectors(docs: DataFrame, ids: DataFrame, make: Callable[[str], tuple[np.ndarray, np.ndarray]], rows: int = SAMPLE_ROWS) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors of the whole texts of at most ``rows`` of the ids, picked by a hash of the id and listed by id.

    ``docs`` has ``doc_id`` and ``text``; of several texts under one id the greatest counts. The ids
    are chosen first; their number is fixed, so they are broadcast. Vectors are made where the texts
    are: a vector has an entry for each different n-gram, and texts never reach the driver.
    """
    picked = ids.select("doc_id").distinct().orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(rows)
    found = docs.join(F.broadcast(picked), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK_BYTES):
            some = [make(t) for t in b.column(1).to_pylist()]
            yield batch(doc_id=b.column(0), index=binaries([i.astype(np.int32).tobytes() for i, _ in some]), value=binaries([v.astype(np.float32).tobytes() for _, v in some]))

    out = sorted(map_arrow(found, vectors, "doc_id long, index binary, value binary").collect())
    return [(np.frombuffer(r["index"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(np.float64)) for r in out]


def scored(docs: DataFrame, weights: np.ndarray, bias: float, forms: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: the logistic function of bias plus the sparse dot product; the weights' size is fixed."""
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), float(bias)))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = shared.value
        for b in blocks(batches, "text", BLOCK_BYTES):
            margins = []
            for text in b.column(1).to_pylist():
                index, value = vector(text, forms)
                margins.append(b0 + float(w[index] @ value))
            yield batch(doc_id=b.column(0), score=pa.array(1 / (1 + np.exp(-np.clip(np.array(margins), -30, 30)))))

    return map_arrow(texts(docs, id_col, text_col), score, "doc_id long, score double")
