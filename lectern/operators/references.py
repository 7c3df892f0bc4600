"""References, figures and links between text and assets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.ids import extract_doi, last_year
from lectern.functions.text import normalize_text


def reference_rows(blocks: DataFrame, key: str, text: str = "text", order: str = "pos") -> DataFrame:
    """``key, pos, label, raw, doi, year`` of reference texts; each (label, text) once, at its first place."""
    raw = normalize_text(F.col(text))
    label = F.regexp_extract(raw, r"^\[?([0-9]+)[\].]? ", 1)
    body = F.regexp_replace(raw, r"^\[?[0-9]+[\].]? +", "")
    rows = blocks.select(key, F.col(order).alias("pos"), label.alias("label"), body.alias("raw")).where("raw != ''")
    first = rows.groupBy(key, "label", "raw").agg(F.min("pos").alias("pos"))
    return first.select(key, "pos", "label", "raw", extract_doi(F.col("raw")).alias("doi"), last_year(F.col("raw")).alias("year"))


def build_reference(authors: Column, title: Column, journal: Column, year: Column) -> Column:
    """Up to six authors, then title, journal and year, joined by full stops."""
    return F.concat_ws(". ", F.when(F.size(authors) > 0, F.concat_ws(", ", F.slice(authors, 1, 6))), title, journal, year)


def limit_references(refs: DataFrame, key: str, mode: str, n: int = 10) -> DataFrame:
    if mode == "none":
        return refs.limit(0)
    if mode == "all":
        return refs
    return refs.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("_n") <= n).drop("_n")


def figure_mentions(paragraphs: DataFrame, key: str, text: str = "text", order: str = "pos") -> DataFrame:
    """``key, label, pos``: the first paragraph that mentions each figure ("Figs 1, 2 and 3a", "Fig. S3").

    A mention of a panel, such as 3a, also counts for its figure, 3.
    """
    number = "[a-z]?[0-9]+[a-z]?"
    groups = F.regexp_extract_all(F.lower(text), F.lit(rf"\bfig(?:ure)?s?\.?\s+({number}(?:\s*(?:,|and|&)\s*{number}){{0,6}})"))
    numbers = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(f"({number})"))))
    labels = F.array_distinct(F.concat(numbers, F.transform(numbers, lambda x: F.regexp_replace(x, "([0-9])[a-z]$", "$1"))))
    return paragraphs.select(key, F.col(order).alias("pos"), F.explode(labels).alias("label")).groupBy(key, "label").agg(F.min("pos").alias("pos"))


def place_figures(paragraphs: DataFrame, figures: DataFrame, key: str) -> DataFrame:
    """Each figure after the first paragraph that mentions it, once; the rest at the end (null place)."""
    return figures.join(figure_mentions(paragraphs, key), [key, "label"], "left")


def rewrite_links(links: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """``key, url`` get ``path``: by whole URL, else by file name, unless several assets have that name.

    ``assets`` has ``key, url, path``.
    """
    base = lambda c: F.lower(F.regexp_extract(F.regexp_replace(c, r"[?#].*$", ""), "([^/]*)$", 1))
    exact = assets.groupBy(key, "url").agg(F.min("path").alias("_exact"))
    named = assets.groupBy(key, base(F.col("url")).alias("_base")).agg(F.min("path").alias("_named"), F.count_distinct("path").alias("_n")).where("_n = 1 AND _base != ''").drop("_n")
    out = links.withColumn("_base", base(F.col("url"))).join(exact, [key, "url"], "left").join(named, [key, "_base"], "left")
    return out.withColumn("path", F.coalesce("_exact", "_named", "url")).drop("_base", "_exact", "_named")


def drop_shown(assets: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """Assets whose URL is not already in the text."""
    return assets.join(shown.select(key, "url").distinct(), [key, "url"], "left_anti")


def match_hints(headings: DataFrame, hints: DataFrame, key: str) -> DataFrame:
    """Forward-only matching: the n-th heading of a name takes the n-th hint of that name, if hints stay in order.

    ``headings``: key, pos, name; ``hints``: key, ord, name, kind. A heading matches the first hint after the last match.
    """
    @F.pandas_udf("array<string>")
    def match(names: pd.Series, hints: pd.Series) -> pd.Series:
        out = []
        for heads, wanted in zip(names, hints, strict=True):
            found, i = [], 0
            for name in heads:
                j = next((j for j in range(i, len(wanted)) if wanted[j]["name"] == name), None)
                found.append(None if j is None else wanted[j]["kind"])
                i = i if j is None else j + 1
            out.append(found)
        return pd.Series(out)

    heads = headings.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "name"))).alias("heads"))
    wanted = hints.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "name", "kind"))).alias("hints"))
    rows = heads.join(wanted, key, "left").withColumn("hints", F.coalesce(F.transform("hints", lambda h: F.struct(h["name"], h["kind"])), F.array().cast("array<struct<name:string,kind:string>>")))
    rows = rows.select(key, F.explode(F.arrays_zip("heads", match(F.col("heads.name"), F.col("hints")).alias("kind"))).alias("h"))
    return rows.select(key, F.col("h.heads.pos").alias("pos"), F.col("h.heads.name").alias("name"), F.col("h.kind").alias("kind"))
