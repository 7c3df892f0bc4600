"""Markdown lines to sections and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalize_text, token_estimate
from lectern.functions.verdicts import section_kind, section_priority


def lines(docs: DataFrame, key: str, markdown: str) -> DataFrame:
    """``key, pos, line, head, heading, level``."""
    rows = docs.select(key, F.posexplode(F.split(markdown, "\n")).alias("pos", "line"))
    head = F.col("line").rlike("^#{1,6} ")
    return rows.withColumn("head", head).withColumn("heading", F.when(head, F.trim(F.regexp_replace("line", "^#+", "")))).withColumn("level", F.when(head, F.length(F.regexp_extract("line", "^#+", 0)).cast("long")))


def from_markdown(docs: DataFrame, key: str, markdown: str, fallback: str = "Full Text") -> DataFrame:
    """``key, section, heading, level, kind, text``: sections with text, numbered by their headings.

    Text before the first heading is section 0 under ``fallback``, level 2. The order of lines is kept.
    """
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(docs, key, markdown).withColumn("section", F.sum(F.col("head").cast("long")).over(w))
    body = F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line"))))
    out = rows.groupBy(key, "section").agg(F.max("heading").alias("heading"), F.max("level").alias("level"), body.alias("body"))
    text = F.regexp_replace(F.array_join(F.transform("body", lambda x: x["line"]), "\n"), "^[ \n]+|[ \n]+$", "")
    out = out.withColumn("text", text).where("text != ''")
    heading = F.coalesce("heading", F.lit(fallback))
    return out.select(key, "section", heading.alias("heading"), F.coalesce("level", F.lit(2)).alias("level"), section_kind(heading).alias("kind"), "text")


def render(rows: DataFrame, key: str) -> DataFrame:
    """``key, markdown, tokens``: headings shifted so that the highest is of level 2, and kept within 2 to 6."""
    w = Window.partitionBy(key)
    shift = F.greatest(F.lit(0), F.min("level").over(w) - 2)
    rows = rows.withColumn("_level", F.greatest(F.lit(2), F.least(F.lit(6), F.col("level") - shift)).cast("int"))
    block = F.concat(F.repeat(F.lit("#"), F.col("_level")), F.lit(" "), F.col("heading"), F.lit("\n"), F.col("text"))
    rows = rows.select(key, "section", block.alias("block"), token_estimate(F.col("text")).alias("n"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "block"))), lambda x: x["block"]), "\n\n")
    return rows.groupBy(key).agg(joined.alias("markdown"), F.sum("n").cast("long").alias("tokens"))


def render_in_budget(rows: DataFrame, key: str, budget: int) -> DataFrame:
    """Sections taken by priority while they fit, then shown in their own order."""
    w = Window.partitionBy(key).orderBy("_p", "section").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_p", section_priority(F.col("heading"))).withColumn("_n", token_estimate(F.col("text")))
    return render(rows.withColumn("_upto", F.sum("_n").over(w)).where(F.col("_upto") <= budget).drop("_p", "_n", "_upto"), key)


def first_abstract(rows: DataFrame, key: str) -> DataFrame:
    return rows.where("kind = 'abstract'").groupBy(key).agg(F.min_by("text", "section").alias("abstract"))


def renderable(rows: DataFrame, key: str) -> DataFrame:
    """Sections with text, and empty ones whose next section with text is deeper."""
    w = Window.partitionBy(key).orderBy("section").rowsBetween(1, Window.unboundedFollowing)
    some = normalize_text(F.col("text")) != ""
    following = F.first(F.when(some, F.col("level")), ignorenulls=True).over(w)
    return rows.withColumn("_next", following).where(some | (F.col("_next") > F.col("level"))).drop("_next")
