"""Resolution of queries, evidence of full text, assembly and assessment of articles."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.ids import extract_doi, is_http_url
from lectern.functions.text import normalize_text, ordered_distinct
from lectern.functions.verdicts import confidence, content_kind


def classify_query(c: Column) -> Column:
    """``doi``, ``url`` or ``title``, or ``empty``."""
    t = normalize_text(c)
    bare = t.rlike(r"^(?i)(doi:[ ]*|https?://(dx\.)?doi\.org/)?10\.[0-9]{4,9}/[^ ]+$")
    return F.when(t == "", "empty").when(bare, "doi").when(is_http_url(c), "url").otherwise("title")


def resolve(queries: DataFrame, works: DataFrame, query: str = "query") -> DataFrame:
    """``kind`` and ``doi`` of each query: from the query itself, or by its title among ``works`` (doi, title_key)."""
    from lectern.functions.text import title_key

    rows = queries.withColumn("kind", classify_query(F.col(query))).withColumn("_key", title_key(F.col(query)))
    named = works.groupBy("title_key").agg(F.min("doi").alias("_doi"), F.count_distinct("doi").alias("_n")).where("_n = 1").drop("_n")
    out = rows.join(named, F.col("_key") == F.col("title_key"), "left")
    return out.withColumn("doi", F.coalesce(extract_doi(F.col(query)), F.when(F.col("kind") == "title", F.col("_doi")))).drop("_key", "_doi", "title_key")


def probe(evidence: DataFrame, key: str, kinds: Sequence[str], kind: str = "evidence") -> DataFrame:
    """Evidence found per key, in the order of ``kinds``; any makes full text likely, none leaves it unknown."""
    found = evidence.groupBy(key).agg(F.collect_set(kind).alias("_e"))
    listed = F.filter(F.array(*[F.lit(k) for k in kinds]), lambda k: F.array_contains("_e", k))
    return found.select(key, listed.alias("evidence")).withColumn("state", F.when(F.size("evidence") > 0, "likely_yes").otherwise("unknown"))


def open_licence(urls: Column) -> Column:
    return F.coalesce(F.exists(urls, lambda u: F.contains(F.lower(u), F.lit("creativecommons"))), F.lit(False))


def assemble(sections: DataFrame, key: str) -> DataFrame:
    """``key, abstract, body_chars, body_words, body_blocks, body_headings, refs, ratio`` from section rows."""
    from lectern.functions.text import word_count

    t, k = F.col("text"), F.col("kind")
    pick = lambda kind, value: F.sum(F.when(k == kind, value).otherwise(0)).cast("long")
    out = sections.groupBy(key).agg(
        F.min_by("text", F.when(k == "abstract", F.col("section"))).alias("abstract"),
        pick("body", F.length(t)).alias("body_chars"),
        pick("body", word_count(t)).alias("body_words"),
        F.count_if(k == "body").alias("body_blocks"),
        F.count_if((k == "body") & (normalize_text(F.col("heading")) != "")).alias("body_headings"),
        F.count_if(k == "references").alias("refs"),
    )
    a = word_count(F.coalesce("abstract", F.lit("")))
    return out.withColumn("ratio", F.when(a > 0, F.col("body_words") / a).otherwise(F.col("body_words").cast("double")))


def assess(articles: DataFrame, signals: str = "signals", losses: str = "losses") -> DataFrame:
    """Adds ``content_kind``, ``flags`` and ``confidence``; a hard signal takes the body away, never the abstract."""
    gate = F.size(signals) > 0
    enough = (F.col("body_chars") >= 300) & (F.col("body_words") >= 60)
    kind = content_kind(enough & ~gate, F.coalesce(F.col("abstract"), F.lit("")) != "")
    weak = enough & ~((F.col("body_blocks") >= 2) & (F.col("body_headings") >= 1))
    flags = F.filter(F.array(F.when(gate, "access_gate_detected"), F.when(~enough, "insufficient_body"), F.when(weak, "weak_body_structure")), lambda x: x.isNotNull())
    return articles.withColumn("content_kind", kind).withColumn("flags", flags).withColumn("confidence", confidence(kind, gate, gate, ~enough, weak, F.col(losses)))


def merge_trails(*trails: Column) -> Column:
    """Steps of several trails, each once, in order."""
    return ordered_distinct(F.concat(*trails))


def contract_issues(docs: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """``key, rule, problem`` for each broken rule.

    ``rules`` has ``key, rule, kind, pattern, n``: kinds ``include``, ``exclude``, ``regex`` and ``count`` (exactly n matches).
    """
    rows = docs.select(key, text).join(rules, key)
    found = F.contains(F.col(text), F.col("pattern"))
    count = F.size(F.regexp_extract_all(F.col(text), F.concat(F.lit("("), F.col("pattern"), F.lit(")"))))
    broken = (
        F.when((F.col("kind") == "include") & ~found, "missing").when((F.col("kind") == "exclude") & found, "forbidden")
        .when((F.col("kind") == "regex") & ~F.rlike(F.col(text), F.col("pattern")), "no_match").when((F.col("kind") == "count") & (count != F.col("n")), "wrong_count")
    )
    return rows.select(key, "rule", broken.alias("problem")).where("problem IS NOT NULL")


def expected_vs_actual(samples: DataFrame, manifest: DataFrame, key: str, field: str) -> DataFrame:
    """Samples whose field differs from the manifest's, nulls compared as equal; samples without entry are left out."""
    return samples.join(manifest.select(key, F.col(field).alias("_expected")), key).where(~F.col(field).eqNullSafe(F.col("_expected"))).withColumnRenamed("_expected", "expected")


def stop_markers(rows: DataFrame, key: str, order: str, text: str, markers: Sequence[str]) -> DataFrame:
    """Rows before the first one that starts with a marker, once content has begun; earlier marker rows are dropped alone."""
    at = F.lower(F.trim(text)).rlike("^(?:" + "|".join(re.escape(m.lower()) for m in markers) + ")")
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max((~F.col("_at")).cast("int")).over(w)
    flagged = rows.withColumn("_at", at).withColumn("_begun", F.coalesce(begun, F.lit(0)))
    cut = F.max((F.col("_at") & (F.col("_begun") == 1)).cast("int")).over(w)
    return flagged.withColumn("_cut", cut).where("_cut = 0 AND NOT _at").drop("_at", "_begun", "_cut")


def downgrade(sections: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Sections that stay once an article counts for less: all of ``fulltext``, abstracts of ``abstract_only``, none of ``metadata_only``.

    ``targets`` has ``key, target``; an article without one keeps everything.
    """
    rows = sections.join(targets.select(key, "target"), key, "left")
    return rows.where("target IS NULL OR target = 'fulltext' OR (target = 'abstract_only' AND kind = 'abstract')").drop("target")


def abstract_in_budget(text: Column, label_tokens: int, budget: Column) -> Column:
    """An abstract whole where it fits beside its label, else its start with dots, else empty."""
    room = F.greatest(budget - label_tokens, F.lit(0))
    whole = F.ceil(F.length(text) / 4) <= room
    cut = F.rtrim(F.substring(text, F.lit(1), (4 * F.greatest(room - label_tokens, F.lit(0))).cast("int")))
    return F.when(whole, text).when(cut != "", F.concat(cut, F.lit("..."))).otherwise("")
