"""Routing of identifiers to providers through small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.ids import clean_doi, host, host_matches
from lectern.functions.text import journal_key

#: Provider, order, domains, DOI prefixes, publisher names.
CATALOG = [
    ("elsevier", 1, ["sciencedirect.com", "elsevier.com"], ["10.1016/"], ["elsevier", "elsevier bv", "elsevier ltd"]),
    ("copernicus", 8, ["copernicus.org"], ["10.5194/"], ["copernicus", "copernicus publications", "copernicus gmbh"]),
    ("annualreviews", 12, ["annualreviews.org"], ["10.1146/"], ["annual reviews", "annual reviews inc"]),
    ("asm", 14, ["journals.asm.org"], ["10.1128/"], ["american society for microbiology", "asm", "asm press"]),
    ("acs", 15, ["acs.org"], ["10.1021/"], ["american chemical society", "acs publications"]),
]


def catalog(spark: SparkSession) -> DataFrame:
    """A few rows, a fixed number: safe to broadcast."""
    return spark.createDataFrame(CATALOG, "provider string, rank int, domains array<string>, prefixes array<string>, names array<string>")


def by_domain(df: DataFrame, url: str, key: str, rules: DataFrame) -> DataFrame:
    """The first rule in order whose domain is the URL's host or a parent of it; ``rules``: provider, rank, domain.

    The host's own suffixes make this an equi-join, so that rules need not be compared with all rows.
    """
    labels = F.split(host(F.col(url)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rows = df.select(key, F.explode(suffixes).alias("domain"))
    best = rows.join(rules, "domain").groupBy(key).agg(F.min(F.struct("rank", "provider")).alias("_best"))
    return df.join(best, key, "left").withColumn("provider", F.col("_best.provider")).drop("_best")


def by_doi(df: DataFrame, doi: str, rules: DataFrame) -> DataFrame:
    """Provider of the DOI's registrant; of rules for one prefix the last counts. ``rules``: provider, rank, prefix."""
    last = rules.groupBy("prefix").agg(F.max_by("provider", "rank").alias("doi_provider"))
    return df.withColumn("prefix", F.concat(F.substring_index(clean_doi(F.col(doi)), "/", 1), F.lit("/"))).join(F.broadcast(last), "prefix", "left").drop("prefix")


def by_publisher(df: DataFrame, publisher: str, rules: DataFrame) -> DataFrame:
    names = rules.select(journal_key(F.col("name")).alias("_key"), F.col("provider").alias("publisher_provider")).dropDuplicates(["_key"])
    return df.withColumn("_key", journal_key(F.col(publisher))).join(F.broadcast(names), "_key", "left").drop("_key")


def candidates(signals: DataFrame, key: str) -> DataFrame:
    """``key, provider, signal, rank`` to each provider once, by its best signal (domain, publisher, doi), in order."""
    w = Window.partitionBy(key, "provider").orderBy("rank")
    order = Window.partitionBy(key).orderBy("rank")
    return signals.where("provider IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").withColumn("place", F.row_number().over(order).cast("long")).drop("_n")


def select_probe(probes: DataFrame, key: str, state: str, order: str) -> DataFrame:
    """The first positive probe, else the first unknown, else the first negative."""
    rank = F.when(F.col(state) == "positive", 0).when(F.col(state) == "unknown", 1).otherwise(2)
    return probes.groupBy(key).agg(F.min(F.struct(rank.alias("r"), F.col(order), F.col(state))).alias("_p")).select(key, F.col(f"_p.{state}").alias(state), F.col(f"_p.{order}").alias(order))


def waterfall(steps: DataFrame, key: str, order: str, ok: str, goes_on: str) -> DataFrame:
    """The first step that succeeds, if no step before it failed in a way that ends the run."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max((F.col(ok) | ~F.col(goes_on)).cast("int")).over(w), F.lit(0))
    return steps.withColumn("_ended", ended).where("_ended = 0").where(F.col(ok)).drop("_ended")


def link_domain(url_host, domain):
    return host_matches(url_host, domain)
