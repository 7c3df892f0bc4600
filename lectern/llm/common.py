"""What the corpus operators share: shared-folder tables, shipping of code, Arrow helpers and fixed-size bitmaps."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.shipping import ship

#: Slots of a bitmap, whole numbers of 32,768-slot buckets: 1 MB where the members were not counted, and at most 128 MB.
BITMAP_SLOTS, MOST_SLOTS = 1 << 23, 1 << 30
#: Answers of the largest groups that are broadcast; any other group has at most one row in so many.
TOP_GROUPS = 4096


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session's own in ``spark.checkpoint.dir``, which driver and executors share; the file system deletes it when the driver ends.

    Where the setting is absent a local folder serves a local master (tests); a cluster without it is refused.
    """
    if not getattr(spark, "_lectern_dir", None):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="lectern-")
        spark._lectern_dir = f"{base.rstrip('/')}/lectern-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._lectern_dir)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark._lectern_dir


#: Tables that the innermost :func:`scratch` will delete.
_written: list[list[DataFrame]] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read again: lineage ends there, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    if _written:
        _written[-1].append(out)
    lighten(spark)
    return out


@contextlib.contextmanager
def scratch(keep: list[DataFrame]) -> Iterator[None]:
    """What :func:`saved` writes inside is deleted at the end, but for the tables that ``keep`` holds by then."""
    _written.append([])
    try:
        yield
    finally:
        stays = {t._lectern_path for t in keep}
        drop(*[t for t in _written.pop() if t._lectern_path not in stays])


def drop(*tables: DataFrame) -> None:
    """Delete what :func:`saved` wrote, once nothing reads it any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._lectern_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lighten(spark: SparkSession) -> None:
    """The driver collects its garbage and gives back what its JVM and its Python have freed, inside the JVM's heap and beside it."""
    spark._jvm.System.gc()
    trim_native(spark)
    gc.collect()
    _give_back()


def trim_native(spark: SparkSession) -> str | None:
    """Free native memory of the driver's JVM goes back to the system, as ``jcmd`` does it; None where this JVM has no such command.

    Through reflection, since the bean server's own class is not open to callers.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName

    def array(kind: object, values: list) -> object:
        out = new(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    try:
        kinds = [named(k) for k in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, kinds))
        asked = [jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", new(jvm.Object, 0), new(jvm.String, 0)]
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.Object, asked))
    except Py4JError:
        return None


def shrink(spark: SparkSession) -> None:
    """Driver and executors collect their garbage and give back the heap that earlier work left behind, which they would keep otherwise.

    One task for each core, so that free executors get theirs; what one that gets none holds is no more than before.
    """
    lighten(spark)
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).where("java_method('java.lang.System', 'gc') IS NOT NULL").count()


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` and ``text``, whatever else the input has; a null text becomes empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: What operators remember between the tasks of one Python worker: name to a function that forgets it.
MEMOS: dict[str, Callable[[], None]] = {}
_last: str | None = None


def enter(name: str) -> None:
    """A worker serves one operator after another: what the last one remembered goes, and free memory is given back."""
    global _last
    if _last != name:
        for forget in MEMOS.values():
            forget()
        gc.collect()
        _last = name
    _give_back()


def _give_back() -> None:
    """Free memory of this Python process goes back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


#: Rows of one Arrow batch between the JVM and a Python worker, unless the session sets another number.
BATCH_ROWS = 2048
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    if df.sparkSession.conf.get(_BATCH) == "10000":
        df.sparkSession.conf.set(_BATCH, str(BATCH_ROWS))
    name = f.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(name)
        yield from f(batches)

    return df.mapInArrow(run, schema)


def batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def binaries(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary())


def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows, cut so that a piece holds one row or at most ``limit`` bytes of text, and small batches joined."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(text))
        lens = np.diff(np.frombuffer(col.buffers()[1], dtype=np.int32 if pa.types.is_string(col.type) or pa.types.is_binary(col.type) else np.int64)[col.offset : col.offset + len(col) + 1].astype(np.int64))
        start = 0
        ends = np.cumsum(lens)
        while start < b.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit - size, side="right")))
            if size and stop == start + 1 and ends[start] - done + size > limit:
                yield _joined(held)
                held, size = [], 0
                continue
            held.append(b.slice(start, stop - start))
            size += int(ends[stop - 1] - done)
            start = stop
            if size >= limit:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows arrive sorted by ``keys`` (long columns); yields each run of equal keys as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for i in range(len(cuts) - 1):
            held.append(b.slice(cuts[i], cuts[i + 1] - cuts[i]))
            if i < len(cuts) - 2:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def slots_for(members: int) -> int:
    """Slots at which one row in 16 that is no member shares a member's slot, within the bounds; beyond them more rows do."""
    return min(MOST_SLOTS, max(BITMAP_SLOTS, 1 << (16 * members).bit_length()))


def bitmap(members: DataFrame, *columns: Column, slots: int = BITMAP_SLOTS) -> DataFrame:
    """A set of members, by a hash of the columns, as rows of 4 KB that hold 32,768 slots each."""
    s = members.select(slot_of(*columns, slots=slots).alias("_s"))
    return s.groupBy(F.bitmap_bucket_number("_s").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_bits"))


def slot_of(*columns: Column, slots: int = BITMAP_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("long")


def with_member(df: DataFrame, bits: DataFrame, name: str, *columns: Column, slots: int = BITMAP_SLOTS) -> DataFrame:
    """``df`` with a boolean column that says whether its slot is in the bitmap (of as many slots)."""
    s, p = f"_slot_{name}", F.bitmap_bit_position(F.col(f"_slot_{name}"))
    held = bits.withColumnsRenamed({"_bucket": f"_bucket_{name}", "_bits": f"_bits_{name}"})
    byte = F.conv(F.hex(F.substring(F.col(f"_bits_{name}"), (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (p % 8).cast("int")) == 1, F.lit(False))
    asked = df.withColumn(s, slot_of(*columns, slots=slots))
    return asked.join(F.broadcast(held), F.bitmap_bucket_number(F.col(s)) == F.col(f"_bucket_{name}"), "left").withColumn(name, hit).drop(s, f"_bucket_{name}", f"_bits_{name}")


def answered(rows: DataFrame, answers: DataFrame, key: list[str], weight: str, values: list[str]) -> DataFrame:
    """``rows`` left-joined with ``answers`` on the columns ``key``, which name one answer each; adds the columns ``values``.

    ``weight`` is about the number of rows that ask for an answer. The ``TOP_GROUPS`` heaviest answers
    are broadcast and their rows spread evenly over the tasks of the join, so that no group of rows,
    however large, meets in one task.
    """
    # Always 0, but no literal: the optimizer would take that out of the join's keys.
    nought = F.pmod(F.xxhash64(*key), F.lit(1)).cast("long")
    top = answers.orderBy(F.desc(weight), *key).limit(TOP_GROUPS).select(*[F.col(k).alias(f"_top_{k}") for k in key], F.struct(*values).alias("_top"))
    rest = answers.select(*[F.col(k).alias(f"_rest_{k}") for k in key], F.struct(*values).alias("_rest"), nought.alias("_none"))
    on = lambda side: functools.reduce(lambda a, b: a & b, [F.col(k) == F.col(f"{side}{k}") for k in key])
    asked = rows.join(F.broadcast(top), on("_top_"), "left").withColumn("_spread", F.when(F.col("_top").isNull(), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1))
    out = asked.join(rest, on("_rest_") & (F.col("_spread") == F.col("_none")), "left")
    return out.select(*[F.col(c) for c in rows.columns], *[F.coalesce(f"_top.{v}", f"_rest.{v}").alias(v) for v in values])


def row_key(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, with the key of the row in place of its id: rows that share an id, or have none, are told apart by their text."""
    rows = texts(docs)
    return rows.select(key_of(F.col("doc_id"), F.sha2(F.col("text").cast("binary"), 256)).alias("doc_id"), "text")


def key_of(doc_id: Column, text_sha256: Column) -> Column:
    """A 64-bit key of an id, which may be null, and the hash of a text."""
    return F.xxhash64(F.coalesce(doc_id, F.lit(0).cast("long")), doc_id.isNull(), text_sha256)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not among those of ``dropped`` (one column, ``doc_id``, as :func:`row_key` names it), all columns kept.

    Rows with one id, or without any, fall only for their own text; a null text counts as empty.
    ``dropped`` is counted, so it should be a written table. A bitmap sized by that count lets most
    rows through where they are; only rows that share a slot with a dropped key are shuffled and
    joined. Beyond 64 million dropped keys the bitmap keeps its 128 MB, and a growing share of the
    rows takes part in the join. Columns travel in a struct, so that none can clash with a helper.
    """
    gone = dropped.select(F.col("doc_id").alias("_gone")).distinct()
    slots = slots_for(dropped.count())
    key = key_of(F.col("doc_id").cast("long"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    rows = docs.select(F.struct("*").alias("_row"), key.alias("_id"))
    asked = with_member(rows, bitmap(gone, F.col("_gone"), slots=slots), "_maybe", F.col("_id"), slots=slots)
    rest = asked.where("_maybe").join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    return asked.where(~F.col("_maybe")).select("_row.*").unionByName(rest.select("_row.*"))
