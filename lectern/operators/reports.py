"""Reports: status counts, issues, benchmark summaries, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_summary(results: DataFrame, key: str, status: str, statuses: Sequence[str], sample: str, n: int = 3) -> DataFrame:
    """Per key the attempts, a count for every status (zero where none) and the first ``n`` samples in order."""
    counts = [F.count_if(F.col(status) == s).alias(f"n_{s}") for s in statuses]
    w = Window.partitionBy(key).orderBy(sample)
    ranked = results.withColumn("_n", F.row_number().over(w))
    first = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_n") <= n, F.col(sample)))), lambda x: x.cast("string")), ",")
    return ranked.groupBy(key).agg(F.count(F.lit(1)).alias("attempted"), *counts, first.alias("samples"))


def issue_summary(results: DataFrame, flags: str, sample: str, n: int = 5) -> DataFrame:
    """Per flag the number of rows and the first ``n`` samples."""
    rows = results.select(F.explode(flags).alias("issue_flag"), sample)
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("issue_flag").orderBy(sample)))
    first = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_n") <= n, F.col(sample)))), lambda x: x.cast("string")), ",")
    return ranked.groupBy("issue_flag").agg(F.count(F.lit(1)).alias("n"), first.alias("samples"))


def category_counts(results: DataFrame, categories: str) -> DataFrame:
    """Rows per category; a row without any counts as ``ok``."""
    each = F.explode(F.when(F.size(categories) == 0, F.array(F.lit("ok"))).otherwise(F.col(categories)))
    return results.select(each.alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def benchmark_summary(runs: DataFrame, keys: list[str], ok: Column, ms: Column) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ok"), F.round(F.avg(ok.cast("int")), 4).alias("ok_rate"), F.round(F.avg(ms), 2).alias("mean_ms"))


def winner(summary: DataFrame, name: str) -> DataFrame:
    """The best by success rate, then speed, then name."""
    return summary.agg(F.max_by(name, F.struct(F.col("ok_rate"), -F.col("mean_ms"), F.col(name))).alias("winner"))


def worst_failure(failures: DataFrame, key: str, code: str, priority: dict[str, int], message: str, order: str) -> DataFrame:
    """Per key the code of least priority number, and all messages in order."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col(code)), F.lit(1 << 30))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, message))), lambda x: x[message]), "; ")
    return failures.groupBy(key).agg(F.min_by(F.col(code), F.struct(rank, F.col(order))).alias(code), said.alias("messages"))


def trail(events: DataFrame, key: str, order: list[str], step: str) -> DataFrame:
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(step).alias("_step")))), lambda x: x["_step"]), " -> ")
    return events.groupBy(key).agg(said.alias("trail"))


def exit_code(results: DataFrame, status: str, priority: Sequence[tuple[str, int]]) -> DataFrame:
    """The code of the gravest status among the rows; 0 for none."""
    rank = F.lit(len(priority))
    for i, (name, _) in reversed(list(enumerate(priority))):
        rank = F.when(F.col(status) == name, i).otherwise(rank)
    codes = F.array(*[F.lit(c) for _, c in priority], F.lit(0))
    return results.agg(F.get(codes, F.coalesce(F.min(rank), F.lit(len(priority)))).alias("exit_code"))


def stage_seconds(rows: DataFrame, key: str, stage: str, seconds: str) -> DataFrame:
    """Seconds of each stage, added up; each stage once in a map."""
    per = rows.groupBy(key, stage).agg(F.sum(seconds).alias("_s"))
    return per.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(stage, "_s")))).alias("stages"))


def totals(results: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row: the number of results, and of those with each flag."""
    return results.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(name) for name, c in flags.items()])


def unstable(results: DataFrame, key: str, signature: Column) -> DataFrame:
    """Keys whose results do not all have one signature, with the number of different ones."""
    return results.groupBy(key).agg(F.count_distinct(signature).alias("signatures")).where("signatures > 1")
