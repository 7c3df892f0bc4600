"""Operators over rows in order: carried state, runs, budgets, prefixes and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import token_estimate, truncate_to_tokens


def carry_forward(df: DataFrame, keys: list[str], order: list[str], marker: Column, name: str, default: str | None = None) -> DataFrame:
    """The last non-null ``marker`` at or before each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(marker, ignorenulls=True).over(w)
    return df.withColumn(name, state if default is None else F.coalesce(state, F.lit(default)))


def longest_run(df: DataFrame, keys: list[str], order: list[str], member: Column, size: Column) -> DataFrame:
    """Per key the most members in a row and the most size in a row; the two may come from different runs."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_in", member.cast("int")).withColumn("_size", size)
    rows = rows.withColumn("_breaks", F.sum(1 - F.col("_in")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "_breaks").agg(F.sum("_in").alias("n"), F.sum(F.col("_in") * F.col("_size")).alias("s"))
    return runs.groupBy(*keys).agg(F.max("n").cast("long").alias("run_rows"), F.max("s").cast("long").alias("run_size"))


def keep_in_budget(df: DataFrame, keys: list[str], order: list[str], text: str, budget: int, remainder: int = 64) -> DataFrame:
    """The prefix whose tokens fit, then the first row beyond it cut to what is left if that is over ``remainder``.

    Adds ``tokens``, ``truncated`` and the text as kept. Later rows are not tried, even if they would fit.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("tokens", token_estimate(F.col(text)))
    upto = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_upto", upto).withColumn("_left", F.lit(budget) - (F.col("_upto") - F.col("tokens")))
    rows = rows.withColumn("_over", F.sum((F.col("_upto") > budget).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fits, cut = F.col("_upto") <= budget, (F.col("_over") == 1) & (F.col("_left") > remainder)
    room = F.greatest(F.lit(32), 4 * F.col("_left")).cast("int")
    head = F.regexp_replace(F.left(F.col(text), room), "[ ,;:\n]+$", "")
    return rows.where(fits | cut).withColumn("truncated", ~fits).withColumn(text, F.when(fits, F.col(text)).otherwise(F.concat(head, F.lit("...")))).drop("_upto", "_left", "_over")


def before_first(df: DataFrame, keys: list[str], order: list[str], stop: Column, inclusive: bool = True) -> DataFrame:
    """Rows up to the first one where ``stop`` holds, with or without that."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if inclusive else 0)
    return df.withColumn("_stopped", F.coalesce(F.sum(stop.cast("int")).over(w), F.lit(0))).where("_stopped = 0").drop("_stopped")


def after_first(df: DataFrame, keys: list[str], order: list[str], start: Column) -> DataFrame:
    """Drops everything from the first row where ``start`` holds on: a cut-off of what follows the content."""
    return before_first(df, keys, order, start, inclusive=False)


def round_robin(df: DataFrame, key: str, order: list[str], name: str = "turn") -> DataFrame:
    """The i-th row of each key gets turn i; sorted by turn and key this alternates between keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def first_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    return round_robin(df, key, order, "_turn").where(F.col("_turn") <= n).drop("_turn")


def seen_before(df: DataFrame, keys: list[str], order: list[str], flag: Column, name: str) -> DataFrame:
    """Whether ``flag`` held in an earlier row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.max(flag).over(w), F.lit(False)))


def truncated(text: Column, budget: int) -> Column:
    return truncate_to_tokens(text, budget)
