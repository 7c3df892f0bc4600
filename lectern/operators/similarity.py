"""Text similarity: blocked candidates with built-ins, exact measures in Arrow functions on what is left."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lectern.functions.text import normalize_text, overlap_key, title_key
from lectern.sources.shipping import ship

#: Bytes of passages that are compared with all texts at once, as a broadcast.
PASSAGE_BYTES = 8 << 20
#: Bytes of query texts that a worker holds with an index at once.
PHRASE_BYTES = 4 << 20
#: Words at the start that two texts must share: least and most.
HEAD_WORDS = 12, 24
#: Texts that are sketched at once.
SKETCH_ROWS = 1024
#: Words whose hashes a worker holds.
WORD_CODES = 1 << 17
#: Rows of a key beyond which it is parted by lengths.
HOT_ROWS = 1024
#: Slots of a bitmap for each member, and most slots (32 MB), whole numbers of 32,768-slot buckets.
MEMBER_SLOTS, MOST_SLOTS = 16, 1 << 28
#: Pairs that are compared at once by their counts of characters.
MET_PAIRS = 1 << 16
#: Rows on either side of a tile of titles.
TILE_ROWS = 4096


def token_jaccard(a: Column, b: Column) -> Column:
    """Of distinct words of two title keys; 0 where either has none."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))
    x, y = words(a), words(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def indel(a: str, b: str) -> float:
    """2 * LCS / (m + n); 1 for two empty strings. Rows of the table are bit vectors (Hyyro)."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    s = mask
    for c in b:
        u = s & places.get(c, 0)
        s = ((s + u) | (s - u)) & mask
    return 2 * (len(a) - s.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp, in this order of arguments."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def blended_score(jaccard: Column, ratio: Column) -> Column:
    return F.round(0.7 * jaccard + 0.3 * ratio, 6)


def confident(top: Column, second: Column) -> Column:
    return (top >= 0.90) & (top - F.coalesce(second, F.lit(0.0)) >= 0.05)


def text_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, t``: of documents with one language and normalised text the one of smallest id."""
    rows = docs.select("doc_id", "lang", normalize_text(F.col("text")).alias("t"))
    first = rows.groupBy("lang", F.md5(F.col("t").cast("binary")).alias("_key")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return rows.join(first, "doc_id", "left_semi")


def candidate_pairs(classes: DataFrame, head: int = 200, delta: int = 64) -> DataFrame:
    """Pairs of one language and first ``head`` characters whose lengths differ by ``delta`` at most.

    Copies are left to their class (:func:`text_classes`), and lengths are banded, so that a large
    group of copies does not meet itself.
    """
    rows = classes.where(F.length("t") >= head).select("doc_id", "lang", F.length("t").alias("n"), F.md5(F.left("t", F.lit(head)).cast("binary")).alias("head"))
    band = F.floor(F.col("n") / (delta + 1))
    a = rows.select(F.col("doc_id").alias("left_id"), "lang", "head", F.col("n").alias("left_n"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    b = rows.select(F.col("doc_id").alias("right_id"), "lang", "head", F.col("n").alias("right_n"), band.alias("band"))
    return a.join(b, ["lang", "head", "band"]).where((F.col("left_id") < F.col("right_id")) & (F.abs(F.col("left_n") - F.col("right_n")) <= delta)).select("left_id", "right_id")


def edit_bound(n: int, least: float) -> int:
    """Most single-character insertions and deletions between a text of ``n`` characters and one alike to the ratio ``least``.

    Matched characters are a common subsequence, so d of them leave a ratio of 1 - d / (m + n) at most, and m <= n + d.
    """
    return int(2 * n * (1 - least) / least + 1e-6)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits of which each depends on all of ``x`` (splitmix64), one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordCodes(dict):
    """64-bit hashes of words, those of the last :data:`WORD_CODES` new ones held."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CODES:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code


def _runs(codes: np.ndarray, length: int, mark: int) -> np.ndarray:
    """A hash of each run of ``length`` codes."""
    n = max(0, len(codes) - length + 1)
    out = np.full(n, mark, np.uint64)
    for k in range(length):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n])
    return out


def _first_grams(grams: np.ndarray, spoilt: int) -> np.ndarray:
    """The smallest hashes of the grams, repeats counted as different: with ``spoilt`` of them lost one at least remains."""
    grams = np.sort(grams)
    place = np.arange(len(grams))
    fresh = np.ones(len(grams), bool)
    fresh[1:] = grams[1:] != grams[:-1]
    if not fresh.all():
        place -= np.maximum.accumulate(np.where(fresh, place, 0))
        grams = np.where(fresh, grams, _mixed(grams + place.astype(np.uint64)))
        grams.sort()
    return grams[: spoilt + 1]


def gram_keys(text: str, least: float, codes: WordCodes | None = None) -> np.ndarray:
    """Keys of which two different texts share one if they are alike to the ratio ``least``.

    An edit spoils four runs of three words at most. A text with too few of these for its bound also
    gives runs of eight characters, of which an edit spoils eight; only two such texts need them.
    Runs are told apart by 64-bit hashes: equal hashes of different runs cost a candidate, and lose none.
    """
    edits = edit_bound(len(text), least)
    if not edits:
        return np.empty(0, np.int64)
    codes = WordCodes() if codes is None else codes
    words = text.split()
    runs = _runs(np.fromiter(map(codes.__getitem__, words), np.uint64, len(words)), 3, 1)
    out = _first_grams(runs, 4 * edits)
    if len(runs) <= 4 * edits:
        out = np.concatenate([out, _first_grams(_runs(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), 8, 2), 8 * edits)])
    return out.view(np.int64)


def plain_text(text: str | None) -> str:
    """:func:`normalize_text` of one string."""
    t = re.sub(r"[ \t\r\f\v]+", " ", (text or "").replace("\xa0", " "))
    return re.sub(r"\s*\n\s*", "\n", t).strip()


def text_sketches(docs: DataFrame, least: float) -> DataFrame:
    """``doc_id, lang, digest, n, keys, bag`` of documents with text: hash and length of the normalised text, its
    :func:`gram_keys` and counts of its characters in 32 groups, a byte each, of which only the lowest 8 bits are held.
    One pass; only these are moved later."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "lang", "text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for b in (b.slice(k, SKETCH_ROWS) for b in batches for k in range(0, b.num_rows, SKETCH_ROWS)):
            at, out = [], []
            for k, t in enumerate(map(plain_text, b.column(2).to_pylist())):
                if t:
                    raw = t.encode("utf-32-le", "surrogatepass")
                    at.append(k)
                    out.append((xxhash.xxh3_128_digest(raw), len(t), gram_keys(t, least, codes), np.bincount(np.frombuffer(raw, np.uint32) & 31, minlength=32).astype(np.uint8).tobytes()))
            digest, n, keys, bag = zip(*out, strict=True) if out else ((), (), (), ())
            own = [b.column(i).take(pa.array(at, pa.int64())) for i in range(2)]
            made = [pa.array(digest, pa.binary()), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(bag, pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, *made], names=["doc_id", "lang", "digest", "n", "keys", "bag"])

    # A function over batches runs once a row; as a column it ran again in the filter that the optimizer moved before it.
    made = T.StructType.fromDDL("digest binary, n int, keys array<long>, bag binary")
    return rows.mapInArrow(sketch, T.StructType([*rows.schema.fields[:2], *made.fields]))


def _kept(df: DataFrame) -> DataFrame:
    """The rows computed now and held on executors' disks; left to the parts of a plan that read them, each would compute its own."""
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, doc_id, hot`` of rows sorted by key, for keys that more than one row has; hot: more than :data:`HOT_ROWS` have it."""
    keys, ids = np.empty(0, np.int64), np.empty(0, np.int64)
    held = 0  # rows of the first key that have been given out

    def told(k: int, last: bool) -> pa.RecordBatch:
        """The first k rows, which end with a key unless the rest of it is hot too."""
        starts = np.flatnonzero(np.concatenate([[True], keys[1:k] != keys[: k - 1]]))
        size = np.diff(np.append(starts, k))
        size[0] += held
        if not last:
            size[-1] = HOT_ROWS + 1
        size = np.repeat(size, np.diff(np.append(starts, k)))
        some = size > 1
        return pa.RecordBatch.from_arrays([pa.array(keys[:k][some]), pa.array(ids[:k][some]), pa.array(size[some] > HOT_ROWS)], names=["key", "doc_id", "hot"])

    for b in batches:
        if not b.num_rows:
            continue
        keys, ids = np.concatenate([keys, b.column(0).to_numpy()]), np.concatenate([ids, b.column(1).to_numpy()])
        if held and keys[0] != last_key:
            held = 0
        open_at = int(np.searchsorted(keys, keys[-1]))
        if open_at:
            yield told(open_at, True)
            keys, ids, held = keys[open_at:], ids[open_at:], 0
        if held + len(keys) > HOT_ROWS:
            yield told(len(keys), False)
            held, last_key, keys, ids = HOT_ROWS, keys[-1], keys[:0], ids[:0]
    if len(keys):
        yield told(len(keys), True)


def _met(least: float, delta: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From ``key, band, n, doc_id, bag`` sorted by the first three: ``left_id, right_id`` that have a key and band in
    common and that lengths and counts of characters leave."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 32), np.uint8)]
        found: list[np.ndarray] = []

        def given() -> pa.RecordBatch:
            out = np.unique(np.concatenate(found), axis=0)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["left_id", "right_id"])

        for b in batches:
            if not b.num_rows:
                continue
            old = len(parts[0])
            bag = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(-1, 32)
            new = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy(), bag]
            key, band, n, ids, bags = parts = [np.concatenate(x) for x in zip(parts, new, strict=True)]
            run = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (band[1:] != band[:-1]))]) << 32
            most = np.minimum(delta, (1 - least) * 2 * n + 1e-6).astype(np.int64)  # n is that of the longer text
            low = np.searchsorted(run + n, run + n - np.minimum(most, n))
            at = np.arange(old, len(n))
            count = at - low[old:]
            ends = np.cumsum(count)
            first = 0
            while first < len(at):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + MET_PAIRS, "right")))
                c = count[first:last]
                j = np.repeat(at[first:last], c)
                i = np.arange(len(j)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[at[first:last]], c)
                # Of counts only the lowest 8 bits are known: the difference is this at least.
                apart = np.abs((bags[i] - bags[j]).view(np.int8).astype(np.int16)).sum(1)
                some = (apart <= (1 - least) * (n[i] + n[j]) + 1e-6) & (ids[i] != ids[j])
                if some.any():
                    x, y = ids[i[some]], ids[j[some]]
                    found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
                first = last
            if sum(map(len, found)) >= MET_PAIRS:
                yield given()
            reach = run[-1] + n[-1] - min(delta, n[-1])
            keep = int(np.searchsorted(run + n, reach))
            parts = [x[keep:] for x in parts]
        if found:
            yield given()

    return pairs


def edits_pairs(classes: DataFrame, least: float, delta: int = 64) -> DataFrame:
    """``left_id, right_id``: all pairs of one language that can be alike to ``least``, by shared keys, lengths and counts of characters.

    Most keys are those of one text alone: the others are found from keys and ids, before lengths and counts go with
    them, so that a pair is judged where its key is and leaves only if it can be alike. Frequent keys are parted by
    bands of lengths.
    """
    keys = classes.where("lang IS NOT NULL").select("doc_id", "lang", F.explode("keys").alias("key")).select(F.xxhash64("lang", "key").alias("key"), "doc_id")
    keys = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_several, "key long, doc_id long, hot boolean")
    band = F.floor(F.col("n") / (delta + 1)).cast("int")
    bands = F.when(F.col("hot"), F.array(band, band + 1)).otherwise(F.array(F.lit(-1)))
    rows = keys.join(classes.select("doc_id", "n", "bag"), "doc_id").select("key", F.explode(bands).alias("band"), "n", "doc_id", "bag")
    return rows.repartition("key", "band").sortWithinPartitions("key", "band", "n").mapInArrow(_met(least, delta), "left_id long, right_id long").distinct()


def within(a: str, b: str, most: int) -> bool:
    """Whether ``most`` insertions and deletions lead from one to the other (Myers: for each count of edits and diagonal
    the furthest point, of the diagonals from which the end can still be reached)."""
    m, n = len(a), len(b)
    aim = m - n
    if abs(aim) > most:
        return False
    far = {1: 0}
    for d in range(most + 1):
        left = most - d
        low, high = max(-d, aim - left, d - 2 * n), min(d, aim + left, 2 * m - d)
        for k in range(low + (low + d & 1), high + 1, 2):
            down, right = far.get(k + 1, -1), far.get(k - 1, -2) + 1
            x = down if down >= right else right
            y = x - k
            if x < 0 or x > m or y > n:
                continue
            if x < m and y < n and a[x] == b[y]:
                step = 8
                while a[x : x + step] == b[y : y + step] and x + step <= m and y + step <= n:
                    x, y, step = x + step, y + step, 2 * step
                while step:
                    if x + step <= m and y + step <= n and a[x : x + step] == b[y : y + step]:
                        x, y = x + step, y + step
                    step //= 2
            if x >= m and y >= n:
                return True
            far[k] = x
    return False


def _asked(rows: DataFrame, ids: DataFrame, members: int) -> DataFrame:
    """All rows whose ``doc_id`` is among ``ids``, of which there are ``members`` at most, and the few others that share a slot of a bitmap with one.

    They are found where they are; the exact join is left to the reader (a semi join here would be moved before the bitmap).
    """
    slots = min(MOST_SLOTS, -(-max(1, members) * MEMBER_SLOTS // 32768) * 32768)
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("long")
    bits = ids.select(slot.alias("_s")).groupBy(F.bitmap_bucket_number("_s").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_bits"))
    place = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    maybe = rows.withColumn("_slot", slot).join(F.broadcast(bits), F.bitmap_bucket_number("_slot") == F.col("_bucket")).where(F.getbit(byte, (place % 8).cast("int")) == 1)
    return maybe.select(*rows.columns)


def _matched(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From ``left_id, right_id, a, b``: ``left_id, right_id, ratio`` of the normalised texts (Ratcliff-Obershelp), where it is ``least`` at least.

    The longest common subsequence rules most others out before.
    """

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, last, right, held = SequenceMatcher(None, "", ""), "", "", True
        for batch in batches:
            at, out = [], []
            for k, (x, y) in enumerate(zip(map(plain_text, batch.column(2).to_pylist()), batch.column(3).to_pylist(), strict=True)):
                if y != last:
                    last, right, held = y, plain_text(y), False
                if not within(x, right, int((1 - least) * (len(x) + len(right)) + 1e-6)):
                    continue
                if not held:  # what is known of the right text serves all its pairs
                    matcher.set_seq2(right)
                    held = True
                matcher.set_seq1(x)
                if (ratio := matcher.ratio()) >= least:
                    at.append(k)
                    out.append(ratio)
            own = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(out, pa.float64())], names=["left_id", "right_id", "ratio"])

    return ratios


def near_pairs(docs: DataFrame, least: float = 0.995, delta: int = 64) -> DataFrame:
    """``left_id, right_id, ratio``: pairs of one language, of lengths ``delta`` apart at most and alike to the ratio ``least``.

    Equal texts form a class, named by its smallest id: each other member is paired with that id at
    ratio 1, and classes are paired by these ids, so that links of copies follow from the rows.
    Empty texts are paired with nothing.
    """
    sketches = _kept(text_sketches(docs, least))
    classes = sketches.groupBy("lang", "digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "keys", "bag")])
    several = classes.where("copies > 1").select(F.col("lang").alias("_lang"), F.col("digest").alias("_digest"), F.col("doc_id").alias("left_id"))
    copies = sketches.select("doc_id", "lang", "digest").join(several, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("digest") == F.col("_digest"))).where("doc_id != left_id")
    pairs = _kept(edits_pairs(classes, least, delta))
    asked = pairs.select(F.explode(F.array("left_id", "right_id")).alias("doc_id"))
    rows = _asked(docs.select("doc_id", "lang", "text"), asked, 2 * pairs.count())
    side = lambda x, t: rows.select(F.col("doc_id").alias(f"{x}_id"), F.col("lang").alias(f"{x}_lang"), F.col("text").alias(t))
    pairs = pairs.join(side("left", "a"), "left_id").join(side("right", "b"), "right_id").where("left_lang = right_lang").select("left_id", "right_id", "a", "b")
    # A function over batches judges a pair once; as a column it ran again for those that its own filter left.
    found = pairs.mapInArrow(_matched(least), T.StructType([*pairs.schema.fields[:2], T.StructField("ratio", T.DoubleType())]))
    return found.unionByName(copies.select("left_id", F.col("doc_id").alias("right_id"), F.lit(1.0).alias("ratio")))


def passage_overlap(docs: DataFrame, passages: DataFrame, least: int = 160, single: int = 240) -> DataFrame:
    """Documents that hold whole passages: one of ``single`` characters, or two of ``least``.

    The passages form a query set: its size is checked, and it meets all documents in blocks that fit.
    """
    chunks = passages.select(overlap_key(F.col("text")).alias("chunk")).where(F.length("chunk") >= least)
    size = chunks.agg(F.sum(F.octet_length("chunk"))).first()[0] or 0
    blocks = max(1, math.ceil(size / PASSAGE_BYTES))
    body = docs.select("doc_id", overlap_key(F.col("text")).alias("body"))
    found = None
    for k in range(blocks):
        some = chunks if blocks == 1 else chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(blocks)) == k)
        part = body.join(F.broadcast(some), F.contains("body", "chunk")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("matched"), F.max(F.length("chunk")).alias("longest"))
        found = part if found is None else found.unionByName(part)
    out = found.groupBy("doc_id").agg(F.sum("matched").cast("long").alias("matched"), F.max("longest").cast("long").alias("longest"))
    return out.withColumn("overlaps", (F.col("longest") >= single) | (F.col("matched") >= 2))


class Phrases:
    """A block of query texts, and which of them match a text: one contains the other, or they share a long head.

    Both sides are words with single spaces. In a contained text all words but the first and last are
    whole words of the other side too, so the rarest of these proposes, and the strings decide.
    """

    def __init__(self, rows: Iterable[tuple[object, str | None]]) -> None:
        ids: dict[str, list] = {}
        for i, t in rows:
            if key := semantic_key(t):
                ids.setdefault(key, []).append(i)
        self.texts, self.ids = list(ids), list(ids.values())
        self.words = [t.split(" ") for t in self.texts]
        self.longest = max(map(len, self.texts), default=0)
        self.held: dict[str, list[int]] = {}
        self.heads: dict[tuple[str, ...], list[int]] = {}
        for i, w in enumerate(self.words):
            for x in set(w):
                self.held.setdefault(x, []).append(i)
            if len(w) >= HEAD_WORDS[0]:
                self.heads.setdefault(tuple(w[: HEAD_WORDS[0]]), []).append(i)
        self.anchors: dict[str, list[int]] = {}
        self.short = []
        for i, w in enumerate(self.words):
            if len(w) > 2:
                self.anchors.setdefault(min(w[1:-1], key=lambda x: (len(self.held[x]), -len(x), x)), []).append(i)
            else:
                self.short.append(i)

    def matches(self, text: str | None) -> Iterator[object]:
        t = semantic_key(text)
        if not t:
            return
        words = t.split(" ")
        found = {i for i in self.short if self.texts[i] in t}
        found.update(i for x in self.anchors.keys() & set(words) for i in self.anchors[x] if self.texts[i] in t)
        if len(t) <= self.longest:
            inside = min((self.held.get(x, ()) for x in words[1:-1]), key=len, default=range(len(self.texts)))
            found.update(i for i in inside if t in self.texts[i])
        for i in self.heads.get(tuple(words[: HEAD_WORDS[0]]), ()):
            need = min(HEAD_WORDS[1], max(HEAD_WORDS[0], min(len(words), len(self.words[i])) // 3))
            if words[:need] == self.words[i][:need]:
                found.add(i)
        for i in found:
            yield from self.ids[i]


def semantic_key(text: str | None) -> str:
    """Runs of letters, digits and underscores in lower case, with single spaces."""
    return " ".join(re.findall(r"\w+", (text or "").lower()))


def semantic_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id``: one text contains the other, or both start with the same words.

    Of the words of the shorter text a third must be shared at the start, 12 at least and 24 at most.
    Null and empty texts match nothing. The items form a query set that meets all documents in blocks.
    """
    ship(docs.sparkSession)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / PHRASE_BYTES))
    schema = T.StructType([docs.schema["doc_id"], items.schema["item_id"]])
    body = docs.select("doc_id", "text")
    found = None
    for k in range(blocks):
        rows = items.select("item_id", "text").where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        part = body.mapInArrow(_matcher([tuple(r) for r in rows], to_arrow_type(items.schema["item_id"].dataType)), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _matcher(rows: list[tuple], kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(rows)
        for b in batches:
            at, out = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for i in phrases.matches(t):
                    at.append(k)
                    out.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(out, kind)], names=["doc_id", "item_id"])

    return match


def title_tiles(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``tile, lo, hi, part, id, t``: rows cut by id into parts, and every two parts in one tile, so that all pairs meet.

    A tile holds about twice ``TILE_ROWS`` rows, whatever words or copies they have.
    """
    rows = rows.select(F.col(key).alias("id"), F.col(text).alias("t")).where("id IS NOT NULL AND t != ''")
    n = max(1, math.ceil(rows.count() / TILE_ROWS))
    cuts = sorted(set(rows.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 100 * n)).first()[0] or [])) if n > 1 else []
    parts = len(cuts) + 1
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col("id"))) if cuts else F.lit(0)
    rows = rows.select("id", "t", part.cast("long").alias("part")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    return rows.select((lo * parts + hi).alias("tile"), lo.alias("lo"), hi.alias("hi"), "part", "id", "t")


class Titles:
    """Titles of one side of a tile: their distinct texts, in which each word occurs, and the rows that hold each."""

    def __init__(self, ids: np.ndarray, texts: list[str]) -> None:
        order = np.argsort(ids, kind="stable")
        places: dict[str, int] = {}
        self.ids, self.of = ids[order], np.array([places.setdefault(texts[k], len(places)) for k in order], np.int64)
        self.texts = list(places)
        self.words = [frozenset(t.split(" ")) for t in self.texts]
        self.size = np.array([len(w) for w in self.words], np.int64)
        held: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            for x in w:
                held.setdefault(x, []).append(i)
        self.held = {x: np.array(v, np.int64) for x, v in held.items()}

    def scores(self, words: frozenset[str]) -> np.ndarray:
        """Jaccard similarity of the words with each distinct text."""
        found = [self.held[x] for x in words if x in self.held]
        common = np.bincount(np.concatenate(found), minlength=len(self.size)) if found else np.zeros(len(self.size), np.int64)
        return common / (len(words) + self.size - common)


def _sides(table: pa.Table) -> tuple[Titles, Titles]:
    part, ids, texts = table.column("part").to_numpy(), table.column("id").to_numpy(), np.array(table.column("t").to_pylist(), object)
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    left = Titles(ids[part == lo], texts[part == lo].tolist())
    return left, left if lo == hi else Titles(ids[part == hi], texts[part == hi].tolist())


def _best(table: pa.Table) -> pa.Table:
    """For each row its two best partners of larger id, by rounded score and smaller id."""
    left, right = _sides(table)
    out: list[tuple[int, int, float]] = []
    for k, words in enumerate(left.words):
        s = right.scores(words)[right.of]
        s = np.floor(s * 1e6 + 0.5)
        mine = left.ids[left.of == k]
        pairs: dict[int, list[tuple[int, int]]] = {}
        for i, at in zip(mine.tolist(), np.searchsorted(right.ids, mine, side="right").tolist(), strict=True):
            if at not in pairs:
                rest, pairs[at] = s[at:].copy(), []
                for _ in range(min(2, len(rest))):
                    j = int(rest.argmax())
                    if rest[j] <= 0:
                        break
                    pairs[at].append((int(right.ids[at + j]), int(rest[j])))
                    rest[j] = 0
            out += [(i, j, x) for j, x in pairs[at]]
    a, b, x = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"left_id": pa.array(a, pa.int64()), "right_id": pa.array(b, pa.int64()), "score": pa.array(x, pa.float64())})


def best_titles(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``left_id, right_id, score``: among them the two best partners of each row, of those with a larger id that share a word."""
    ship(rows.sparkSession)
    best = title_tiles(rows, key, text).groupBy("tile").applyInArrow(_best, "left_id long, right_id long, score double")
    return best.withColumn("score", F.round(F.col("score") / 1e6, 6))


def alike_titles(rows: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """``left_id, right_id, score, ratio``: all pairs whose Jaccard similarity is ``least`` at least, with the ratio of their texts.

    The result has a row for every pair, so m rows of one title make m^2 / 2 of them.
    """
    ship(rows.sparkSession)

    def alike(table: pa.Table) -> pa.Table:
        left, right = _sides(table)
        out = [np.zeros((2, 0), np.int64)]
        values = [np.zeros((2, 0))]
        rows_of = np.argsort(right.of, kind="stable")
        ends = np.cumsum(np.bincount(right.of, minlength=len(right.texts)))
        for k, words in enumerate(left.words):
            s = right.scores(words)
            mine = left.ids[left.of == k]
            for c in np.flatnonzero(s >= least).tolist():
                theirs = right.ids[rows_of[ends[c - 1] if c else 0 : ends[c]]]
                a, b = np.repeat(mine, len(theirs)), np.tile(theirs, len(mine))
                some = a < b
                if some.any():
                    out.append(np.stack([a[some], b[some]]))
                    values.append(np.repeat([[s[c]], [indel(left.texts[k], right.texts[c])]], int(some.sum()), axis=1))
        (a, b), (x, y) = np.concatenate(out, axis=1), np.concatenate(values, axis=1)
        return pa.table({"left_id": a, "right_id": b, "score": x, "ratio": y})

    return title_tiles(rows, key, text).groupBy("tile").applyInArrow(alike, "left_id long, right_id long, score double, ratio double")
