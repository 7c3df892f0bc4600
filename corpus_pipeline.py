"""A training corpus from raw documents: quality, exact and near duplicates, benchmark contamination, packing.

Each stage works on all that its predecessor kept. All but the last return the columns of
``documents``; the last returns the place of each remaining document in the packed batches.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import bitmap, drop, key_of, row_key, saved, scratch, shrink, slots_for, texts, with_member, without
from lectern.llm.decontaminate import find_contamination
from lectern.llm.exact_dedup import progressive_exact_dedup
from lectern.llm.near_dedup import near_duplicates
from lectern.llm.packing import pack_by_length
from lectern.llm.quality import score_quality, train_quality
from lectern.llm.queries import byte_bpe, table
from lectern.llm.token_count import count_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects.

    Rows are judged by their text alone, so rows that share an id or have none stand or fall one by
    one, repeated rows together; a null text counts as empty. Without labels every score is one half
    and every row stays. An empty input gives no rows; further columns stay, whatever their names.
    """
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return without(docs, saved(score_quality(row_key(docs), model).where("predicted = 0").select("doc_id"), "rejected"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the document with the largest id; one without id only where none has an id.

    Null and empty texts are equal. Rows that repeat an id and a text stand or fall together; other
    texts under the same id, or without one, are not touched. An empty input gives no rows; further
    columns stay, whatever their names.
    """
    copies = progressive_exact_dedup(docs).where("NOT kept")
    return without(docs, saved(copies.select(key_of(F.col("doc_id"), F.col("text_sha256")).alias("doc_id")), "copies"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates keep the document with the smallest id, a missing one counted as smallest; of one id one text.

    Null and empty texts are near duplicates of nothing and stay. Rows that repeat an id and a text
    stand or fall together. An empty input gives no rows; further columns stay, whatever their names.
    """
    linked = near_duplicates(row_key(docs)).select(F.col("doc_id").alias("key"), "component_id").distinct()
    linked = saved(linked, "linked")
    several = linked.where("key != component_id").select("component_id").distinct()
    slots = slots_for(several.count())
    linked = with_member(linked, bitmap(several, F.col("component_id"), slots=slots), "_several", F.col("component_id"), slots=slots).where("_several")
    rows = texts(docs).select(F.col("doc_id").alias("id"), key_of(F.col("doc_id"), F.sha2(F.col("text").cast("binary"), 256)).alias("key"))
    members = saved(rows.distinct().join(linked, "key"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("first")).select(F.col("first.key").alias("key"))
    return without(docs, saved(members.join(first, "key", "left_anti").select(F.col("key").alias("doc_id")), "near"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold passages of the benchmark: one in 20 of their words or more.

    Rows are judged by their text alone; null and empty texts stay, repeated rows stand or fall
    together, and an empty benchmark drops nothing. An empty input gives no rows; further columns
    stay, whatever their names.
    """
    found = find_contamination(row_key(docs), table(spark, sf_dir, "benchmark"))
    return without(docs, saved(found.where("contaminated").select("doc_id"), "contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into token-budget batches: one row per row, with the columns of :func:`pack_by_length`.

    A null or empty text has 0 tokens and takes a place of length 1; ids are carried through, null
    and repeated ones too. An empty input gives no rows; further columns are left out.
    """
    return pack_by_length(saved(count_tokens(docs, byte_bpe()), "lengths"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _fresh(stage: Stage) -> Stage:
    """The stage, begun with small heaps: an executor's heap and its Python workers share one limit."""

    @functools.wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink(spark)
        return stage(spark, docs, sf_dir)

    return begin


STAGES: list[tuple[str, Stage]] = [(f.__name__, _fresh(f)) for f in (quality, exact_dedup, near_dedup, decontaminate, packing)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next; what a stage wrote on the way is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, kept = docs, []
        with scratch(kept):
            docs = saved(stage(spark, before, sf_dir), name)
            kept.append(docs)
        if name != STAGES[0][0]:
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
