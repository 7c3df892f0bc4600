"""Sources and sinks: query lists, JSON lines, Markdown, stored payloads, manifests, cache listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.ids import decode_html


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a query list without blank ones and comments."""
    return spark.read.text(path).select(F.trim("value").alias("query")).where("query != '' AND NOT startswith(query, '#')")


def read_bodies(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Stored files with their decoded text, by name pattern, folders below included."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "modificationTime", "length", decode_html(F.col("content")).alias("text"))


def read_manifest(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """One row per entry of a JSON object: its key, and the fields of ``entry`` (a DDL schema)."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, struct<{entry}>>").alias("m"))
    return rows.select(F.explode("m").alias("key", "e")).select("key", "e.*")


def envelope_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select("*", F.to_json(F.struct("*")).alias(name))


def write_envelopes(df: DataFrame, path: str) -> None:
    """JSON lines; Spark's commit protocol makes files appear whole or not at all."""
    df.write.mode("errorifexists").json(path)


def write_markdown(df: DataFrame, path: str, kind: str = "content_kind", text: str = "markdown") -> None:
    """Only full texts are written."""
    df.where(F.col(kind) == "fulltext").select(text).write.mode("errorifexists").text(path, lineSep="\n\n")


def crossref_record(message: DataFrame, json: str) -> DataFrame:
    """Canonical metadata from a works record: title, authors, journal, date by preference, links, licences."""
    schema = "DOI string, title array<string>, `container-title` array<string>, publisher string, abstract string, URL string, author array<struct<given:string,family:string,name:string>>, license array<struct<URL:string>>, link array<struct<URL:string>>, `published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>, issued struct<`date-parts`:array<array<int>>>, created struct<`date-parts`:array<array<int>>>"
    m = F.from_json(json, schema)
    rows = message.withColumn("_m", m)
    date = lambda f: F.when(F.size(F.get(F.col(f"_m.{f}.`date-parts`"), F.lit(0))) > 0, F.concat_ws("-", F.transform(F.get(F.col(f"_m.{f}.`date-parts`"), F.lit(0)), lambda x: x.cast("string"))))
    author = lambda a: F.coalesce(a["name"], F.concat_ws(" ", a["given"], a["family"]))
    return rows.select(
        *message.columns,
        F.lower("_m.DOI").alias("doi"),
        F.get(F.col("_m.title"), F.lit(0)).alias("title"),
        F.get(F.col("_m.`container-title`"), F.lit(0)).alias("journal_title"),
        F.col("_m.publisher").alias("publisher"),
        F.transform("_m.author", author).alias("authors"),
        F.coalesce(*[date(f"`{f}`" if "-" in f else f) for f in ("published-print", "published-online", "issued", "created")]).alias("published"),
        F.transform("_m.license", lambda x: x["URL"]).alias("license_urls"),
        F.coalesce(F.exists("_m.license", lambda x: F.contains(x["URL"], F.lit("creativecommons"))), F.lit(False)).alias("open_access"),
        F.col("_m.URL").alias("landing_page_url"),
    )
