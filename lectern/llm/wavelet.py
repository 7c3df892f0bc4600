"""Token shards as wavelet matrices: succinct bit-planes that answer access, count and occurrence queries."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.bpe import WINDOW_CHARS, encoder
from lectern.llm.common import batch, binaries, blocks, map_arrow, saved, texts

MAGIC = b"LWM1"
#: Bits between two entries of the rank directory.
SPAN = 512
#: Bytes of text that go into one shard, unless a single document has more.
SHARD_BYTES = 16 << 20
END_ID = 0
#: Positions of a plane that are parted at once, so that they and their ids stay in the cache.
PART = 1 << 15


class WaveletMatrix:
    """Bit-planes of a sequence, most significant bit first; each plane is stably parted by its bits into the next."""

    def __init__(self, n: int, width: int, planes: list[np.ndarray], ranks: list[np.ndarray]) -> None:
        self.n, self.width, self.planes, self.ranks = n, width, planes, ranks
        self.zeros = [n - int(r[-1]) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, ranks = [], []
        for b in range(width - 1, -1, -1):
            bit = (now & now.dtype.type(1 << b)) != 0
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % (SPAN // 8), np.uint8)])
            planes.append(packed)
            ranks.append(cls._directory(packed))
            parted = np.empty_like(now)
            for some, nil, one, low, high in cls._parts(now, bit, len(now) - int(ranks[-1][-1])):
                parted[low : low + len(nil)] = some.take(nil)
                parted[high : high + len(one)] = some.take(one)
            now = parted
        return cls(len(ids), width, planes, ranks)

    @staticmethod
    def _parts(ids: np.ndarray, bit: np.ndarray, zeros: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
        """Views of ``PART`` ids, the places in each of the bits 0 and 1, and where these two begin in the parted sequence."""
        low, high = 0, zeros
        for i in range(0, len(ids), PART):
            k = bit[i : i + PART]
            nil, one = np.flatnonzero(~k), np.flatnonzero(k)
            yield ids[i : i + PART], nil, one, low, high
            low, high = low + len(nil), high + len(one)

    @staticmethod
    def _directory(packed: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(packed.view(np.uint64)).reshape(-1, SPAN // 64).sum(axis=1, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(ones)])

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position ``i``."""
        span, rest = divmod(i, SPAN)
        part = self.planes[level][span * SPAN // 8 : span * SPAN // 8 + (rest + 7) // 8]
        ones = int(np.unpackbits(part, bitorder="little", count=rest).sum()) if rest else 0
        return int(self.ranks[level][span]) + ones

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) ``bit``."""
        before = self.ranks[level] if bit else np.arange(len(self.ranks[level])) * SPAN - self.ranks[level]
        span = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self.planes[level][span * SPAN // 8 : (span + 1) * SPAN // 8], bitorder="little")
        return span * SPAN + int(np.flatnonzero(part == bit)[k - int(before[span])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.width):
            one = self._rank1(level, i)
            bit = self._rank1(level, i + 1) - one
            value = value << 1 | bit
            i = self.zeros[level] + one if bit else i - one
        return value

    def _down(self, symbol: int, i: int, j: int) -> tuple[int, int]:
        for level in range(self.width):
            a, b = self._rank1(level, i), self._rank1(level, j)
            i, j = (self.zeros[level] + a, self.zeros[level] + b) if symbol >> (self.width - 1 - level) & 1 else (i - a, j - b)
        return i, j

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of ``symbol`` before position ``i``."""
        if symbol >> self.width or symbol < 0:
            return 0
        low, high = self._down(symbol, 0, min(max(i, 0), self.n))
        return high - low

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of ``symbol``; -1 where there are fewer."""
        if not 0 <= k < self.count(symbol):
            return -1
        i = self._down(symbol, 0, self.n)[0] + k
        for level in range(self.width - 1, -1, -1):
            bit = symbol >> (self.width - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """The whole sequence."""
        now = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], bitorder="little", count=self.n).view(bool)
            up, value = np.empty_like(now), now.dtype.type(1 << (self.width - 1 - level))
            for some, nil, one, low, high in self._parts(up, bit, self.zeros[level]):
                some[nil] = now[low : low + len(nil)]
                some[one] = now[high : high + len(one)] | value
            now = up
        return now.astype(np.uint32)


def to_bytes(matrix: WaveletMatrix, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """One shard file: magic, header length, JSON header, then zstd parts (document ends, planes with their directories)."""
    press = zstandard.ZstdCompressor(level=1).compress
    parts = [press(np.asarray(ends, np.int64).tobytes())]
    for plane, rank in zip(matrix.planes, matrix.ranks, strict=True):
        parts += [press(plane.tobytes()), press(rank.astype(np.int64).tobytes())]
    header = json.dumps({"n": matrix.n, "width": matrix.width, "docs": doc_ids, "parts": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *parts])


def from_bytes(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    if data[:4] != MAGIC:
        raise ValueError("not a token shard")
    (size,) = struct.unpack("<I", data[4:8])
    head = json.loads(data[8 : 8 + size])
    at, parts = 8 + size, []
    open_ = zstandard.ZstdDecompressor().decompress
    for k in head["parts"]:
        parts.append(open_(data[at : at + k]))
        at += k
    planes = [np.frombuffer(p, np.uint8) for p in parts[1::2]]
    ranks = [np.frombuffer(p, np.int64) for p in parts[2::2]]
    return WaveletMatrix(head["n"], head["width"], planes, ranks), head["docs"], np.frombuffer(parts[0], np.int64)


def write_token_shards(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode all documents and write the shards to the shared folder: ``shard, n_docs, n_tokens, data``.

    Shards, and documents inside them, are in ascending order of the id (null ids first; rows that
    repeat an id keep some order among themselves). Each text is followed by id 0; a null text
    counts as empty and gives that id alone. A shard holds ``shard_bytes`` of text or one longer
    document. An empty input gives no shards; other columns are ignored. The shards travel in a
    Parquet column, since only Spark reaches the shared store; ``data`` is a whole shard file.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        for k, b in enumerate(blocks(batches, "text", shard_bytes)):
            words = b.column(1).to_pylist()
            huge = {i: enc.resync(w) for i, w in enumerate(words) if len(w) > WINDOW_CHARS * 16}
            ids, lens = enc.encode_block(["" if i in huge else w for i, w in enumerate(words)])
            starts = np.concatenate([[0], np.cumsum(lens)])
            if huge:
                pieces = [huge.get(i, ids[starts[i] : starts[i + 1]]) for i in range(len(words))]
                ids, lens = np.concatenate(pieces), np.array([len(x) for x in pieces], np.int64)
                starts = np.concatenate([[0], np.cumsum(lens)])
            ids = np.insert(ids, starts[1:], END_ID)
            ends = starts[1:] + np.arange(1, len(words) + 1)
            data = to_bytes(WaveletMatrix.build(ids), b.column(0).to_pylist(), ends)
            yield batch(shard=pa.array([(part << 24) + k], pa.int64()), n_docs=pa.array([len(words)], pa.int64()), n_tokens=pa.array([len(ids)], pa.int64()), data=binaries([data]))

    rows = texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return saved(map_arrow(rows, encode, "shard long, n_docs long, n_tokens long, data binary"), "token-shards")


def read_token_shards(shards: DataFrame) -> DataFrame:
    """One row per document from the shard files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it; ``n_tokens`` includes the end id;
    ``ids_crc32`` covers the ids as little-endian unsigned 32-bit integers.
    """

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                matrix, doc_ids, ends = from_bytes(data.as_py())
                ids = matrix.tokens().astype("<u4")
                raw, bounds = memoryview(ids.tobytes()), np.concatenate([[0], ends])
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield batch(shard=pa.array(np.full(len(ends), shard)), doc_id=pa.array(doc_ids, pa.int64()), begin=pa.array(bounds[:-1]), n_tokens=pa.array(np.diff(bounds)), ids_crc32=pa.array(crc, pa.int64()))

    rows = map_arrow(shards.select("shard", "data"), decode, "shard long, doc_id long, begin long, n_tokens long, ids_crc32 long")
    # A row per shard, not per document: the running total is over a few numbers.
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = shards.select(F.col("shard").alias("_shard"), before.alias("_before"))
    return rows.join(offsets, F.col("shard") == F.col("_shard")).select("doc_id", (F.col("_before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
