"""Assets of documents: identity, selection, names, budgets, download outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.ids import path
from lectern.functions.text import first_non_empty, match_key, safe_filename


def identity_key(*urls: Column) -> Column:
    """The first URL that is there."""
    return first_non_empty(*urls)


def split_by_section(assets: DataFrame, section: str = "section") -> tuple[DataFrame, DataFrame]:
    """Assets of the body, and supplementary ones."""
    extra = F.lower(F.coalesce(F.trim(section), F.lit(""))) == "supplementary"
    return assets.where(~extra), assets.where(extra)


def select_by_profile(assets: DataFrame, profile: str, section: str = "section") -> DataFrame:
    """``all``, ``body`` or ``none``."""
    if profile == "none":
        return assets.limit(0)
    return assets if profile == "all" else split_by_section(assets, section)[0]


def unique_names(assets: DataFrame, keys: list[str], url: str, order: str, name: str = "file") -> DataFrame:
    """Safe file names from URLs; repeats of a name in one document get ``_2``, ``_3`` before the extension."""
    base = F.lower(safe_filename(F.regexp_extract(path(F.col(url)), "([^/]*)$", 1)))
    stem, end = F.regexp_extract(base, r"^(.*?)(\.[a-z0-9]+)?$", 1), F.regexp_extract(base, r"^(.*?)(\.[a-z0-9]+)?$", 2)
    n = F.row_number().over(Window.partitionBy(*keys, "_base").orderBy(order))
    rows = assets.withColumn("_base", base).withColumn("_n", n)
    return rows.withColumn(name, F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), end))).drop("_base", "_n")


def within_budget(assets: DataFrame, keys: list[str], order: list[str], size: str, count: int, each: int, total: int) -> DataFrame:
    """In order: assets of at most ``each`` bytes, the first ``count`` of them, while their sum is at most ``total``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = assets.where(F.col(size) <= each).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= count)
    return rows.withColumn("_t", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_t") <= total).drop("_n", "_t")


def drop_repeated_captions(assets: DataFrame, bodies: DataFrame, key: str, caption: str = "caption", body: str = "body") -> DataFrame:
    """Assets whose caption is not already in the body; compared by canonical key."""
    rows = assets.join(bodies.select(key, match_key(F.col(body)).alias("_body")), key, "left")
    said = match_key(F.col(caption))
    return rows.where((said == "") | ~F.coalesce(F.contains("_body", said), F.lit(False))).drop("_body")


def outcomes(results: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    return results.groupBy(*keys).agg(F.count_if(ok).alias("downloaded"), F.count_if(~ok).alias("failed"))


def retryable(assets: DataFrame, failures: DataFrame, key: str, reasons: list[str], reason: str = "reason") -> DataFrame:
    """Assets with a failure that a retry may mend."""
    return assets.join(failures.where(F.col(reason).isin(*reasons)).select(key).distinct(), key, "left_semi")
