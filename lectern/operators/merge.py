"""Merging of records: layers under precedence rules, ordered unions, identity dedupe and retries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalize_text, strip


def merge_pair(primary: DataFrame, secondary: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Full outer merge by key. A field that the primary has wins even if blank, and a blank result becomes null."""
    a, b = primary.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields]), secondary.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields])
    pick = [F.coalesce(F.col(f"_a_{f}"), F.col(f"_b_{f}")).alias(f) for f in fields]
    out = a.join(b, key, "full_outer").select(key, *pick)
    kinds = dict(out.dtypes)
    return out.select(key, *[F.when(strip(F.col(f)) != "", F.col(f)).alias(f) if kinds[f] == "string" else F.col(f) for f in fields])


def merge_layers(layers: DataFrame, key: str, rank: str, fill: Sequence[str] = (), overwrite: Sequence[str] = (), concat: Sequence[str] = ()) -> DataFrame:
    """Layers stacked in one table, merged per key in order of ``rank``.

    ``fill``: the first non-blank value; ``overwrite``: the last one; ``concat``: array fields joined
    in order, each value once regardless of case. Blank values are skipped.
    """
    some = lambda f: F.when(strip(F.col(f).cast("string")) != "", F.col(f))
    aggs = [F.min_by(F.col(f), F.when(some(f).isNotNull(), F.col(rank))).alias(f) for f in fill]
    aggs += [F.max_by(F.col(f), F.when(some(f).isNotNull(), F.col(rank))).alias(f) for f in overwrite]
    joined = [F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(rank, f))), _field(f))).alias(f) for f in concat]
    out = layers.groupBy(key).agg(*aggs, *joined)
    for f in concat:
        out = out.withColumn(f, distinct_by_key(F.col(f), lambda x: F.lower(normalize_text(x))))
    return out


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def distinct_by_key(values: Column, key: Callable[[Column], Column]) -> Column:
    """Array values whose key is not empty and was not seen before, in order."""
    keep = F.transform(values, lambda x: F.struct(key(x).alias("k"), x.alias("v")))
    first = F.filter(keep, lambda x, i: (x["k"] != "") & ~F.exists(F.slice(keep, F.lit(1), i), lambda y: y["k"] == x["k"]))
    return F.transform(first, lambda x: x["v"])


def merge_by_identity(rows: DataFrame, keys: list[str], identity: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Rows of one identity become one: each field from the first row that has it. Blank identities are never merged."""
    own = F.when(F.coalesce(F.trim(identity), F.lit("")) == "", F.concat(F.lit("\0"), F.col(order).cast("string"))).otherwise(F.col(identity))
    some = lambda f: F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) != "", F.col(order))
    aggs = [F.min_by(f, some(f)).alias(f) for f in fields if f != identity]
    return rows.withColumn("_own", own).groupBy(*keys, "_own").agg(F.min(order).alias(order), F.first(identity).alias(identity), *aggs).drop("_own")


def retry_merge(before: DataFrame, retry: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Full outer: what the retry has comes first."""
    a, b = before.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields]), retry.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields])
    return a.join(b, key, "full_outer").select(key, *[F.coalesce(f"_b_{f}", f"_a_{f}").alias(f) for f in fields])


def unresolved_failures(failures: DataFrame, retry: DataFrame, retry_failures: DataFrame, key: str) -> DataFrame:
    """Failures that no retry resolved, and those of the retry."""
    return failures.join(retry.select(key), key, "left_anti").unionByName(retry_failures).dropDuplicates([key])


def upsert(index: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of refreshed keys are replaced as a whole."""
    return index.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def last_write(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def semi(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_semi")
