"""Queries over web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import ids, text, verdicts
from lectern.plans.registry import query, sql_host, sql_tags, sql_words, table


@query(f"SELECT page_id, {sql_tags('html')} AS text FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html_tags(F.col("html")).alias("text"))


@query(f"SELECT page_id, {sql_host('url')} AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def page_title_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", ids.host(F.col("url")).alias("host"), F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"))


_GATES = " OR ".join(f"contains(t, '{p}')" for p in verdicts.GATE_PHRASES)
_CHALLENGES = " OR ".join(f"contains(t, '{p}')" for p in verdicts.CHALLENGE_PHRASES)
_MISSING = " OR ".join(f"contains(t, '{p}')" for p in verdicts.NOT_FOUND_PHRASES)
_SIGNALS = f"list_filter([CASE WHEN {_CHALLENGES} THEN 'cloudflare_challenge' END, CASE WHEN {_MISSING} THEN 'publisher_not_found' END, CASE WHEN {_GATES} THEN 'publisher_paywall' END], lambda x: x IS NOT NULL)"


@query(f"""WITH n AS (SELECT page_id, {sql_host('url')} AS host, {sql_tags('html')} AS clean FROM pages),
m AS (SELECT page_id, host, lower(clean) AS t, length(clean) AS chars, {sql_words('clean')} AS words, ceil(length(clean) / 4)::BIGINT AS tokens FROM n)
SELECT page_id, host, chars::BIGINT AS chars, words, tokens, array_to_string({_SIGNALS}, ',') AS signals,
CASE WHEN len({_SIGNALS}) > 0 THEN {_SIGNALS}[1] WHEN chars >= 300 AND words >= 90 THEN 'fulltext' WHEN words > 0 THEN 'insufficient_body' ELSE 'empty' END AS verdict FROM m""")
def page_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags off, counted, checked for signals against full text, judged: one scan, built-ins only."""
    clean = text.strip_html_tags(F.col("html"))
    rows = table(spark, sf_dir, "pages").select("page_id", ids.host(F.col("url")).alias("host"), clean.alias("clean"))
    rows = rows.select("page_id", "host", F.length("clean").cast("long").alias("chars"), text.word_count(F.col("clean")).alias("words"), text.token_estimate(F.col("clean")).alias("tokens"), verdicts.access_signals(F.lit(""), F.col("clean"), F.lit(None).cast("int")).alias("s"))
    verdict = F.when(F.size("s") > 0, F.get("s", 0)).when((F.col("chars") >= 300) & (F.col("words") >= 90), "fulltext").when(F.col("words") > 0, "insufficient_body").otherwise("empty")
    return rows.select("page_id", "host", "chars", "words", "tokens", F.array_join("s", ",").alias("signals"), verdict.alias("verdict"))


@query(f"SELECT doc_id, array_to_string({_SIGNALS}, ',') AS signals FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE len({_SIGNALS}) > 0")
def access_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", verdicts.access_signals(F.lit(""), F.col("text"), F.lit(None).cast("int")).alias("s"))
    return rows.where(F.size("s") > 0).select("doc_id", F.array_join("s", ",").alias("signals"))


@query("SELECT page_id, regexp_matches(url, '^https?://[^/?#]+') AS web, regexp_replace(url, '([?&](?:api_?key|token|apikey|access_token|key|signature|sig|password)=)[^&#]*', '\\1***', 'g') AS redacted, sha256(url) AS url_key FROM pages")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", ids.is_http_url(u).alias("web"), ids.redact_url(u).alias("redacted"), F.sha2(u.cast("binary"), 256).alias("url_key"))


@query("SELECT html_key, min(page_id) AS page_id, count(*)::BIGINT AS n FROM (SELECT page_id, sha256(html) AS html_key FROM pages) GROUP BY html_key")
def parse_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("html_key"))
    return rows.groupBy("html_key").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))
