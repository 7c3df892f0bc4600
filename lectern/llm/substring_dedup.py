"""Repeated passages: Rabin-Karp hashes of every word window, counted in Spark, merged into removal intervals."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batch, binaries, bitmap, blocks, map_arrow, runs, saved, slots_for, texts, with_member
from lectern.llm.words import split, window_checks, window_hashes, word_hashes

WINDOW = 20
#: Bytes of text in one block; a block sends each of its windows once.
BLOCK_BYTES = 12 << 20
#: Windows that one counting task should get, and bytes of text a word takes at least, on average.
TASK_WINDOWS = 1_000_000
WORD_BYTES = 6
_NULL_ID = np.iinfo(np.int64).min
_SENT = "key long, block long, ids binary, counts binary, hashes binary, checks binary, marks binary, parts binary"


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NULL_ID).to_numpy(zero_copy_only=False)


def windows_of(h: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, hash and check of every window that lies within one row, by row and start."""
    per = np.maximum(n - window + 1, 0)
    rows = np.repeat(np.arange(len(n)), per)
    at = (np.cumsum(n) - n)[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(per) - per, per)
    if not len(at):
        return rows, np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    return rows, window_hashes(h, window)[at], window_checks(h, window)[at]


def _least(ids: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each entry the id of the first one of its run."""
    return ids[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))] if len(ids) else ids


def _send(window: int, parts: int, kind: type):
    """Map side. For each block: its windows, parted by hash, without those that repeat an earlier one of the block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 24
        for k, b in enumerate(blocks(batches, "raw", BLOCK_BYTES)):
            ids = _ids(b.column(0))
            order = np.argsort(ids, kind="stable")
            ids, keys = ids[order], b.column(2).to_numpy(zero_copy_only=False)[order]
            raw = b.column(1).to_pylist()
            h, n = word_hashes([raw[i] for i in order], split)
            del raw
            rows, hashes, checks = windows_of(h, n, window)
            by = np.argsort(hashes, kind="stable")
            sorted_h, sorted_c, sorted_row = hashes[by], checks[by], rows[by]
            new = np.ones(len(by), bool)
            new[1:] = (sorted_h[1:] != sorted_h[:-1]) | (sorted_c[1:] != sorted_c[:-1])
            least = _least(ids[sorted_row], new)
            again = np.zeros(len(by), bool)
            again[1:] = ~new[1:] & (sorted_row[1:] == sorted_row[:-1])
            here = np.empty(len(by), bool)
            here[by] = again | (ids[sorted_row] > least)
            del by, sorted_h, sorted_c, sorted_row, new, least, again
            sent = np.flatnonzero(~here)
            part = ((hashes[sent] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(kind)
            order = np.argsort(part, kind="stable")
            sent, in_part = sent[order], part[order]
            cuts = np.flatnonzero(np.diff(in_part.astype(np.int64), prepend=-1, append=-1)).tolist()
            block = first + k
            out = [[-1 - block, block, ids.tobytes(), n.tobytes(), keys.tobytes(), None, np.packbits(here).tobytes(), part.tobytes()]]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                some = rows[sent[i:j]]
                at = np.flatnonzero(np.diff(some, prepend=-1))
                out.append([int(in_part[i]), block, ids[some[at]].tobytes(), np.diff(at, append=len(some)).astype(np.uint32).tobytes(), hashes[sent[i:j]].tobytes(), checks[sent[i:j]].tobytes(), None, None])
            for i in range(0, len(out), 64):
                key, blk, *rest = zip(*out[i : i + 64], strict=True)
                names = ("ids", "counts", "hashes", "checks", "marks", "parts")
                yield batch(key=pa.array(key, pa.int64()), block=pa.array(blk, pa.int64()), **{c: binaries(list(x)) for c, x in zip(names, rest, strict=True)})

    return run


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side, one part of the hash space at a time: marks each window that a row of smaller id has too."""
    for t in runs(batches, ["key"]):
        if t.column("key")[0].as_py() < 0:
            for b in t.to_batches():
                yield batch(block=b.column(1), part=b.column(0), ids=b.column(2), counts=b.column(3), keys=b.column(4), marks=b.column(6), parts=b.column(7))
            continue
        hashes = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("hashes")]
        ids = [np.repeat(np.frombuffer(a.as_py(), np.int64), np.frombuffer(c.as_py(), np.uint32)) for a, c in zip(t.column("ids"), t.column("counts"), strict=True)]
        h, d, c = np.concatenate(hashes), np.concatenate(ids), np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in t.column("checks")])
        by = np.lexsort((d, c, h))
        sh, sd, sc = h[by], d[by], c[by]
        new = np.ones(len(by), bool)
        new[1:] = (sh[1:] != sh[:-1]) | (sc[1:] != sc[:-1])
        later = np.empty(len(by), bool)
        later[by] = sd > _least(sd, new)
        bits = [np.packbits(x).tobytes() for x in np.split(later, np.cumsum([len(x) for x in hashes])[:-1])]
        sizes = [np.array([len(x)], np.int64).tobytes() for x in hashes]
        none = binaries([None] * len(bits))
        yield batch(block=t.column("block").combine_chunks(), part=t.column("key").combine_chunks(), ids=none, counts=binaries(sizes), keys=none, marks=binaries(bits), parts=none)


def _gather(window: int, kind: type):
    """Per block: the marks of all parts, put back in the order of the windows, become intervals of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["block"]):
            own = int(np.flatnonzero(t.column("part").to_numpy() < 0)[0])
            get = lambda c, k, i=own: np.frombuffer(t.column(c)[i].as_py(), k)
            ids, n, keys, part = get("ids", np.int64), get("counts", np.int64), get("keys", np.int64), get("parts", kind)
            per = np.maximum(n - window + 1, 0)
            marked = np.unpackbits(get("marks", np.uint8), count=int(per.sum())).view(bool).copy()
            sent = np.flatnonzero(~marked)[np.argsort(part, kind="stable")]
            others = sorted((p, i) for i, p in enumerate(t.column("part").to_pylist()) if p >= 0)
            later = [np.unpackbits(np.frombuffer(t.column("marks")[i].as_py(), np.uint8), count=int(np.frombuffer(t.column("counts")[i].as_py(), np.int64)[0])).view(bool) for _, i in others]
            if later:
                marked[sent] = np.concatenate(later)
            rows = np.repeat(np.arange(len(n)), per)[marked]
            starts = (np.flatnonzero(marked) - (np.cumsum(per) - per)[rows]) if len(rows) else rows
            # Marked starts at most one window apart cover one interval.
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + window)
            a = np.flatnonzero(fresh)
            z = np.append(a[1:], len(rows)) - 1
            spans = np.stack([starts[a], starts[z] + window], axis=1).astype(np.int64) if len(a) else np.zeros((0, 2), np.int64)
            of = rows[a]
            cut = np.flatnonzero(np.diff(of, prepend=-1))
            blobs = [x.tobytes() for x in np.split(spans, cut[1:])] if len(cut) else []
            who = of[cut]
            yield batch(of=pa.array(ids[who]), text_hash=pa.array(keys[who]), spans=binaries(blobs))

    return run


def _apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, "raw", BLOCK_BYTES):
        total, gone, kept, where = [], [], [], []
        for raw, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = split(raw)
            total.append(len(words))
            cuts = np.frombuffer(spans, np.int64).reshape(-1, 2).tolist() if spans else []
            where.append([{"start": i, "end": j} for i, j in cuts])
            gone.append(sum(j - i for i, j in cuts))
            for i, j in reversed(cuts):
                del words[i:j]
            kept.append(b" ".join(words))
        spans = pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield batch(doc_id=b.column(0), n_words=pa.array(total, pa.int64()), n_removed=pa.array(gone, pa.int64()), spans=spans, kept_text=binaries(kept).cast(pa.string()))


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, spans, kept_text``.

    Removes each word that lies in a window of ``window`` consecutive words whose sequence also
    starts earlier: in a document of smaller id, or earlier in the same one. ``spans`` are the
    maximal removal intervals (word positions, end exclusive). Windows are judged on the input.

    Every window is hashed (Rabin-Karp, 64 bits and a check of 16 from a second hash; in 5e9 distinct
    windows, of 30 GB of text, the chance that any two are taken for one is about 1 in 100,000). A
    block of documents sends each distinct window once, packed, to the part of the hash space that
    counts it, so that a passage found everywhere costs one entry per block; marks come back as one
    bit per window. A counting task holds about ``TASK_WINDOWS`` windows; messages number blocks
    times parts, 12 million at 30 GB, and approach one per window as the input nears 1 TB. Only documents that lose
    words are shuffled with their text, found by a bitmap of fixed size.

    Null ids count as smaller than any other. Rows that share an id are equally early: none of them
    makes words of another one repeated. Null, empty and short texts lose nothing; repeated rows
    give repeated rows, an empty input gives none, and other columns are ignored.
    """
    rows = texts(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("raw"), F.xxhash64("text").alias("text_hash"))
    size = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    parts = max(1, int(size / WORD_BYTES / TASK_WINDOWS))
    kind = np.uint8 if parts <= 1 << 8 else np.uint16 if parts <= 1 << 16 else np.uint32
    sent = map_arrow(rows, _send(window, parts, kind), _SENT)
    # Each range of the hash space is dealt to a task of its own, by its number.
    dealt = sent.repartitionById(parts, F.pmod("key", F.lit(parts)).cast("int")).sortWithinPartitions("key")
    counted = map_arrow(dealt, _count, "block long, part long, ids binary, counts binary, keys binary, marks binary, parts binary")
    found = saved(map_arrow(counted.repartition("block").sortWithinPartitions("block"), _gather(window, kind), "of long, text_hash long, spans binary"), "passages")
    spans = found.groupBy("of", "text_hash").agg(F.first("spans").alias("spans"))
    number = F.coalesce(F.col("doc_id"), F.lit(int(_NULL_ID)))
    slots = slots_for(found.count())
    asked = with_member(rows, bitmap(found, F.col("of"), F.col("text_hash"), slots=slots), "_hit", number, F.col("text_hash"), slots=slots)
    clean = asked.where(~F.col("_hit")).select("doc_id", "raw", F.lit(None).cast("binary").alias("spans"))
    hit = asked.where("_hit").select("doc_id", "raw", F.col("text_hash").alias("_hash"), number.alias("_id"))
    hit = hit.join(spans, (F.col("_id") == F.col("of")) & (F.col("_hash") == F.col("text_hash")), "left").select("doc_id", "raw", "spans")
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"
    return map_arrow(clean, _apply, schema).unionByName(map_arrow(hit, _apply, schema))
