"""Benchmark contamination: suffix arrays over shards of the training text, searched for every benchmark suffix."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batch, binaries, blocks, drop, map_arrow, saved, texts

WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
ONE_IN = 20
#: Bytes of training text under one suffix array.
SHARD_BYTES = 4 << 20
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is searched in slices.
SLICE_BYTES = 32 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Runs of 0-9, a-z and non-ASCII characters, after A-Z have become a-z."""
    return raw.translate(_LOWER).split()


@dataclass
class Probes:
    """The suffixes of the benchmark's items that start a window, each distinct one once."""

    number: dict[bytes, int]  # word to 1, 2, ...
    bits: int  # of a word's number
    low: np.ndarray  # distinct windows as rows of packed keys, ascending; shorter windows padded with the least word
    high: np.ndarray  # the same, padded with the greatest
    size: np.ndarray  # words of each window
    first: np.ndarray  # items of window k: item[first[k]:first[k + 1]], with the window's place in the item
    item: np.ndarray
    place: np.ndarray
    names: list[str]


def pack_words(columns: np.ndarray, bits: int) -> np.ndarray:
    """Rows of word numbers as byte strings that compare like the rows."""
    per = max(1, 63 // bits)
    n, depth = columns.shape
    keys = np.zeros((n, math.ceil(depth / per)), np.uint64)
    for j in range(depth):
        k, r = divmod(j, per)
        keys[:, k] |= columns[:, j].astype(np.uint64) << np.uint64(bits * (per - 1 - r))
    return keys


def probes(items: list[tuple[str, bytes]], window: int) -> Probes:
    number: dict[bytes, int] = {}
    rows, sizes, owner, place = [], [], [], []
    for k, (_, raw) in enumerate(items):
        ids = [number.setdefault(w, len(number) + 1) for w in words_of(raw)]
        m = min(window, len(ids))
        for at in range(len(ids) - m + 1) if m else ():
            rows.append(ids[at : at + m])
            sizes.append(m)
            owner.append(k)
            place.append(at)
    bits = max(1, (len(number) + 1).bit_length())
    per = max(1, 63 // bits)
    depth = -(-max(sizes, default=1) // per) * per
    low, high = np.zeros((len(rows), depth), np.int64), np.full((len(rows), depth), (1 << bits) - 1, np.int64)
    for i, r in enumerate(rows):
        low[i, : len(r)] = high[i, : len(r)] = r
    # A window and a shorter one that it begins with differ in the high key.
    low, high = pack_words(low, bits), pack_words(high, bits)
    both = np.concatenate([low, high], axis=1)
    _, index, inverse = np.unique(both, axis=0, return_index=True, return_inverse=True) if len(both) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(inverse.ravel(), kind="stable")
    first = np.searchsorted(inverse.ravel()[order], np.arange(len(index) + 1))
    take = lambda x: np.array(x, np.int64)[order]
    return Probes(number, bits, low[index], high[index], np.array(sizes, np.int64)[index], first, take(owner), take(place), [name for name, _ in items])


class Shard:
    """The suffix array of a shard's words. Words outside the benchmark and document ends are 0; a suffix ends there, and
    one that is empty for that reason, so that it equals no suffix of the benchmark, has no entry."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.per, n = max(1, 63 // bits), len(seq)
        padded, on = np.concatenate([seq, np.zeros(self.per, seq.dtype)]), np.ones(n, bool)
        #: The first words of each suffix as one key.
        self.head = np.zeros(n + 1, np.uint64)
        for j in range(self.per):
            on &= padded[j : j + n] != 0
            self.head[:-1] |= np.where(on, padded[j : j + n], 0).astype(np.uint64) << np.uint64(bits * (self.per - 1 - j))
        at = np.flatnonzero(seq).astype(np.int32)
        ends = np.append(np.flatnonzero(seq == 0), n)
        #: Words of each suffix.
        self.length = np.zeros(n + 1, np.int32)
        self.length[at] = ends[np.searchsorted(ends, at)] - at
        self.order = at[np.argsort(self.head[at], kind="stable")]
        self._refine()

    def _refine(self) -> None:
        """Suffixes equal in their first words are told apart by the ranks of what follows; the width known doubles each time."""
        sa, width = self.order, self.per
        if not len(sa):
            return
        key = self.head[sa]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        # A rank is the place of the first suffix that is equal so far; the empty suffix has 0.
        rank = np.zeros(len(self.head), np.int32)
        rank[sa] = np.maximum.accumulate(np.where(new, np.arange(len(sa)), 0)) + 1
        while True:
            alone = new & np.append(new[1:], True)
            tied = np.flatnonzero(~alone & (self.length[sa] > width))
            if not len(tied):
                return
            # Equal ranks mean equal lengths up to the width, so that groups stay together.
            pos = sa[tied]
            first, second = rank[pos], rank[np.minimum(pos + width, len(rank) - 1)]
            by = np.lexsort((second, first))
            pos, first, second = pos[by], first[by], second[by]
            sa[tied] = pos
            change = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
            rank[pos] = tied[np.maximum.accumulate(np.where(change, np.arange(len(tied)), 0))] + 1
            new[tied] |= change
            width *= 2

    def _bound(self, lo: np.ndarray, hi: np.ndarray, skip: int, value: np.ndarray, after: bool) -> np.ndarray:
        """Binary search inside each interval for the first suffix whose key after ``skip`` words is not below (``after``: above) the value."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            at = self.order[mid]
            key = np.where(self.length[at] > skip, self.head[np.minimum(at + skip, len(self.head) - 1)], 0)
            left = key <= value[open_] if after else key < value[open_]
            lo[open_] = np.where(left, mid + 1, lo[open_])
            hi[open_] = np.where(left, hi[open_], mid)

    def interval(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of packed keys the suffixes that lie between the two, as an interval of the array."""
        lo, hi = np.zeros(len(low), np.int64), np.full(len(low), len(self.order), np.int64)
        for k in range(low.shape[1] if len(low) else 0):
            lo, hi = self._bound(lo, hi, k * self.per, low[:, k], False), self._bound(lo, hi, k * self.per, high[:, k], True)
        return lo, np.maximum(lo, hi)


def matches(seq: np.ndarray, p: Probes) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences: the position in the training text and the number of the window."""
    shard = Shard(seq, p.bits)
    lo, hi = shard.interval(p.low, p.high)
    n = hi - lo
    k = np.repeat(np.arange(len(n)), n)
    return shard.order[lo[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)], k


def _search(shared, last: bool, one_in: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Probes = shared.value
        look = p.number.get
        for b in blocks(batches, "raw", SHARD_BYTES):
            docs = [np.fromiter(map(look, words_of(raw), repeat(0)), np.int64) for raw in b.column(1).to_pylist()]
            n = np.array([len(d) for d in docs], np.int64)
            begin = np.cumsum(n + 1) - n - 1
            seq = np.concatenate([np.append(d, 0) for d in docs])
            pos, k = matches(seq, p)
            step = np.zeros(len(seq) + 1, np.int64)
            np.add.at(step, pos, 1)
            np.add.at(step, pos + p.size[k], -1)
            held_spans, held_items, held_longest = (b.column(i).to_pylist() for i in (2, 3, 4))
            for i, blob in enumerate(held_spans):
                for a, z in np.frombuffer(blob, np.int64).reshape(-1, 2).tolist() if blob else ():
                    step[begin[i] + a] += 1
                    step[begin[i] + z] -= 1
            hit = np.cumsum(step[:-1]) > 0
            edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
            a, z = edge[::2], edge[1::2]
            doc = np.searchsorted(begin, a, "right") - 1
            spans = [b""] * len(n)
            for i, s, e in zip(*_grouped(doc), strict=True):
                spans[i] = np.stack([a[s:e] - begin[i], z[s:e] - begin[i]], axis=1).tobytes()
            items, longest = held_items, held_longest
            # (document, window) pairs, then the items that have the window.
            d = np.searchsorted(begin, pos, "right") - 1
            each = p.first[k + 1] - p.first[k]
            row = np.repeat(np.arange(len(k)), each)
            at = np.repeat(p.first[k], each) + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            owner, diagonal, size = p.item[at], pos[row] - p.place[at], p.size[k[row]]
            where, order = pos[row], np.lexsort((pos[row], diagonal, p.item[at], d[row]))
            who, owner, diagonal, where, size = d[row][order], owner[order], diagonal[order], where[order], size[order]
            # Windows that follow each other on one diagonal make one verbatim match.
            new = np.ones(len(who), bool)
            new[1:] = (who[1:] != who[:-1]) | (owner[1:] != owner[:-1]) | (diagonal[1:] != diagonal[:-1]) | (where[1:] != where[:-1] + 1)
            s = np.flatnonzero(new)
            e = np.append(s[1:], len(who)) - 1
            length = where[e] - where[s] + size[e] if len(s) else s
            for i, x, y in zip(*_grouped(who[s]), strict=True):
                items[i] = sorted({*items[i], *(p.names[o] for o in np.unique(owner[s[x:y]]).tolist())})
                longest[i] = max(longest[i], int(length[x:y].max()))
            out = {"doc_id": b.column(0), "raw": b.column(1), "spans": binaries(spans), "items": pa.array(items, pa.list_(pa.string())), "longest": pa.array(longest, pa.int64())}
            if last:
                sums = np.array([int(np.diff(np.frombuffer(x, np.int64).reshape(-1, 2), axis=1).sum()) if x else 0 for x in spans], np.int64)
                pairs = [[{"start": i, "end": j} for i, j in np.frombuffer(x, np.int64).reshape(-1, 2).tolist()] for x in spans]
                out["spans"] = pa.array(pairs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                out |= {"n_words": pa.array(n), "n_hit": pa.array(sums), "contaminated": pa.array((sums > 0) & (one_in * sums >= n))}
                del out["raw"]
            yield batch(**out)

    return run


def _grouped(sorted_keys: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    if not len(sorted_keys):
        return [], [], []
    cut = np.flatnonzero(np.diff(sorted_keys, prepend=-1))
    return sorted_keys[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(sorted_keys)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = ONE_IN, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document: ``doc_id, spans, items, longest, n_words, n_hit, contaminated``.

    Windows are ``window`` consecutive words of an item, or a shorter item whole. ``spans`` are the
    word intervals of the document that occurrences cover, ``items`` the ids (as text, sorted, each
    once) of the items with an occurring window, ``longest`` the words of the longest verbatim match.

    Each block of documents is a shard with an array of all its suffixes, in full order; every
    distinct suffix of the benchmark that starts a window is binary-searched in it, and the interval
    found locates its occurrences. Occurrences that follow each other make the longest matches.
    Nothing is shuffled. The benchmark is read to the driver in slices of ``slice_bytes`` and each
    slice broadcast; with several, the documents are written after each, so that a task holds one.

    Null texts have no words; items without words have no windows; a null item id is listed as an
    empty string, and items that share an id count once. Repeated documents give repeated rows, an
    empty input none, an empty benchmark finds nothing; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).cast("binary").alias("raw"))
    size = items.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    slices = max(1, math.ceil(size / slice_bytes))
    rows = texts(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("raw"), F.lit(b"").alias("spans"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("longest"))
    for k in range(slices):
        some = items if slices == 1 else items.where(F.pmod(F.xxhash64("item", "raw"), F.lit(slices)) == k)
        shared = spark.sparkContext.broadcast(probes([(r.item, bytes(r.raw)) for r in some.collect()], window))
        last = k == slices - 1
        schema = "doc_id long, spans array<struct<start:long,end:long>>, items array<string>, longest long, n_words long, n_hit long, contaminated boolean" if last else "doc_id long, raw binary, spans binary, items array<string>, longest long"
        found = map_arrow(rows, _search(shared, last, one_in), schema)
        if last:
            return found
        rows, before = saved(found, "slices"), rows
        shared.destroy()
        if k:
            drop(before)
