"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import answered, bitmap, texts, with_member

#: Bytes of the text that the second level hashes.
PREFIX_BYTES = 256


def progressive_exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Level 1 groups by byte length, level 2 the survivors by (length, hash of the first
    ``PREFIX_BYTES`` bytes), level 3 the survivors of that by SHA-256 of the whole text. A level
    passes its surviving groups on as a bitmap of fixed size (1 MB); a slot that two groups share
    only sends some rows needlessly to the next level. The full text is hashed for survivors alone
    (``hash_all``: for the others too, but these still need no comparison), and texts are never shuffled.

    Null texts count as empty; empty texts are equal to each other. Of equal texts the row with the
    largest id is kept; rows that repeat an id and a text stand or fall together. A null id loses
    against any other; a group of null ids only keeps its rows. ``text_sha256`` is null where the
    text was not hashed. The answers of the largest groups are broadcast, so that the rows of a
    group of copies, however large, need not meet in one task. An empty input gives no rows; other columns are ignored.
    """
    rows = texts(docs, id_col, text_col).withColumn("_raw", F.col("text").cast("binary")).withColumn("_len", F.octet_length("_raw"))
    by_length = rows.groupBy("_len").count().where("count > 1")
    rows = with_member(rows, bitmap(by_length, F.col("_len")), "_same_length", F.col("_len"))
    prefix = F.when(F.col("_same_length"), F.xxhash64(F.substring("_raw", 1, PREFIX_BYTES)))
    rows = rows.withColumn("_prefix", prefix)
    by_prefix = rows.where("_same_length").groupBy("_len", "_prefix").count().where("count > 1")
    rows = with_member(rows, bitmap(by_prefix, F.col("_len"), F.col("_prefix")), "_same_prefix", F.col("_len"), F.col("_prefix"))
    survives = F.col("_same_length") & F.col("_same_prefix")
    full = F.sha2(F.col("_raw"), 256)
    rows = rows.select("doc_id", survives.alias("_in"), (full if hash_all else F.when(survives, full)).alias("text_sha256"))
    groups = rows.where("_in").groupBy(F.col("text_sha256").alias("_of")).agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # Rows that were ruled out get a key of their own, so that they spread evenly and meet no group.
    key = F.when(F.col("_in"), F.col("text_sha256")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    joined = answered(rows.withColumn("_of", key), groups, ["_of"], "_n", ["_keep", "_n"])
    size = F.coalesce(F.col("_n"), F.lit(1)).cast("long")
    keep = F.when(F.col("_n").isNotNull(), F.col("_keep")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
