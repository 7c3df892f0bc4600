"""Queries over identifiers, addresses, dates and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import ids, text, verdicts
from lectern.operators import assets, merge, routing, tables
from lectern.plans.registry import query, table
from lectern.sources.shipping import ship


def _pick(k: str, *values: str):
    """One of the values, by the remainder of a column."""
    return F.get(F.array(*map(F.lit, values)), (F.col(k) % len(values)).cast("int"))


@query("""SELECT p_partkey, '10.1234/ab-' || p_partkey AS doi, p_partkey % 3 > 0 AS dirty, CASE p_partkey % 4 WHEN 0 THEN '2101.0' || (1000 + p_size) WHEN 1 THEN 'hep-th/9901001' WHEN 2 THEN '2101.0' || (1000 + p_size) END AS arxiv,
p_partkey % 3 = 0 AS api, CASE WHEN p_partkey % 3 = 0 THEN 'https://x.org/a' ELSE 'https://y.org/' || p_partkey END AS public, 'b' || p_partkey || '.png' AS largest,
['.pdf', '.jpg', '.tiff', '.bin'][p_partkey % 4 + 1] AS extension, p_partkey % 3 = 0 AS pdf, p_partkey % 2 = 0 AS access_page, CASE p_partkey % 3 WHEN 0 THEN 'Figure 2' WHEN 1 THEN 'Figure ' || p_size END AS label FROM part""")
def identifier_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_partkey").cast("string"), F.col("p_partkey")
    doi = F.when(k % 3 == 0, F.concat(F.lit("10.1234/ab-"), n)).when(k % 3 == 1, F.concat(F.lit("https://doi.org/10.1234/AB‐"), n, F.lit("."))).otherwise(F.concat(F.lit("doi: 10.1234/Ab–"), n, F.lit("),")))
    arxiv = F.concat(_pick("p_partkey", "arXiv:2101.0", "hep-th/9901001v2", "https://arxiv.org/pdf/2101.0", "no 2101.0"), F.when(k % 4 == 1, "").otherwise((F.col("p_size") + 1000).cast("string")))
    url = F.concat(F.when(k % 3 == 0, F.lit("https://API.y.org/")).otherwise(F.lit("https://y.org/")), n)
    sets = F.concat(F.lit("a.png 1x, b"), n, F.lit(".png 2000w , c.png 1.5x, d.png"))
    kind = _pick("p_partkey", "application/PDF; charset=x", "image/jpeg", "odd/kind", "")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        ids.clean_doi(doi).alias("doi"),
        ids.doi_needs_cleaning(doi).alias("dirty"),
        ids.arxiv_id(arxiv).alias("arxiv"),
        ids.is_api_url(url).alias("api"),
        ids.public_url(F.lit(""), url, F.lit("https://x.org/a")).alias("public"),
        ids.largest_in_srcset(sets).alias("largest"),
        ids.extension(kind, F.when(k % 4 == 2, "http://x/a.TIFF?y=1").otherwise("http://x/a")).alias("extension"),
        ids.looks_like_pdf(F.lit("text/html"), F.when(k % 3 == 0, F.lit("%PDF-1.7")).otherwise("<html>").cast("binary"), F.lit("http://x/a")).alias("pdf"),
        ids.access_page_url(F.when(k % 2 == 0, "https://x.org/doi/ABS/1").otherwise("https://x.org/doi/full/1")).alias("access_page"),
        ids.figure_label(F.when(k % 3 == 0, "Fig. 2 shows").otherwise("Scheme"), F.when(k % 3 == 1, F.concat(F.lit("http://x/fig_"), F.col("p_size").cast("string"), F.lit(".png"))).otherwise("http://x/y.png"), F.lit("none")).alias("label"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN year(o_orderdate)::VARCHAR ELSE year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate) END AS date,
CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate)::VARCHAR ELSE '2001' END AS year, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END::BIGINT AS retry_after, 3.0 * power(2, o_custkey % 4) AS backoff,
CASE o_orderkey % 3 WHEN 0 THEN '1, 3–5' WHEN 1 THEN '2a–4' END AS cited, o_custkey % 3 = 0 AS transient, (o_custkey % 400 >= 300) OR (o_custkey % 400 >= 200 AND false) AS preview,
o_custkey % 4 = 0 AND o_orderkey % 2 = 0 AS weak, o_custkey % 4 = 3 OR (o_custkey % 4 = 2 AND o_orderkey % 2 = 0) AS accepted FROM orders""")
def number_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    parts = F.when(k % 3 == 0, F.array().cast("array<int>")).when(k % 3 == 1, F.array(F.year(d))).otherwise(F.array(F.year(d), F.month(d), F.dayofmonth(d)))
    said = F.when(k % 2 == 0, F.concat(F.lit("Doe 1999, p. 20019, "), F.year(d).cast("string"), F.lit("."))).otherwise("In 2001 (12002)")
    two, odd, even, zero = F.lit(2), k % 2 == 1, k % 2 == 0, F.lit(0)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        ids.date_text(parts).alias("date"),
        ids.last_year(said).alias("year"),
        ids.retry_after_seconds(F.when(even, F.concat(F.lit(" "), k.cast("string"))).otherwise("soon")).alias("retry_after"),
        ids.backoff_seconds(F.lit(3.0), c % 4).alias("backoff"),
        ids.citation_numbers(_pick("o_orderkey", "1 ,3-5", "2a — 4", "1, x")).alias("cited"),
        ids.transient_status(F.when(c % 3 == 0, 503).otherwise(429)).alias("transient"),
        verdicts.preview_acceptable(c % 400, F.lit(200)).alias("preview"),
        verdicts.weak_structure(F.lit(5), F.lit(0), c % 4 != 0, F.lit(False), two, F.when(even, zero).otherwise(two)).alias("weak"),
        verdicts.accepts_structure(c % 4 == 2, F.when(even, 1).otherwise(zero), F.lit(False), F.when(c % 4 == 3, 3).otherwise(zero), F.lit(400), F.lit(False)).alias("accepted"),
    )


@query("""SELECT c_custkey, c_name AS safe, 'j of ' || lower(c_mktsegment) || ' and a' AS journal, 'ann b ' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS author, c_name || ' x' AS abstract, c_name || '|Bo' AS authors, lower(c_mktsegment) AS heading,
'a<sup>2</sup>' || c_nationkey AS bodies, left(c_name || ' ' || c_mktsegment, 12) AS snippet, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' Press' AS display, CASE WHEN c_nationkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS first,
c_name || '|x' AS listed, c_nationkey % 2 = 0 AS prose, CASE WHEN c_nationkey % 3 = 0 THEN 'check access' ELSE '' END AS gates FROM customer""")
def name_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, segment, n = F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        text.safe_text(F.concat(F.lit(" "), name, F.lit("  \n"))).alias("safe"),
        text.journal_key(F.concat(F.lit("J. of  "), segment, F.lit(" &é a"))).alias("journal"),
        text.author_key(F.concat(name, F.lit(",  Ann  B."))).alias("author"),
        text.abstract_text(F.concat(F.lit("**Abstract:** "), name, F.lit(" x"))).alias("abstract"),
        F.array_join(text.split_authors(F.concat(name, F.lit(" ;;  Bo, "))), "|").alias("authors"),
        text.heading_key(F.concat(segment, F.lit(" .: "))).alias("heading"),
        text.sup_sub_bodies(F.concat(F.lit("a<sup> 2\n</sup>"), n.cast("string"))).alias("bodies"),
        text.snippet(F.concat(name, F.lit(" \n"), segment), 12).alias("snippet"),
        text.display_name(F.concat(F.lower(segment), F.lit("_press"))).alias("display"),
        text.first_non_empty(F.when(n % 2 == 0, name).otherwise(" "), segment).alias("first"),
        F.array_join(text.ordered_distinct(F.array(name, F.lit(""), F.lit("x"), F.concat(name, F.lit(" ")))), "|").alias("listed"),
        verdicts.substantial_prose(F.when(n % 2 == 0, F.concat(name, F.lit(". Then so."))).otherwise(name)).alias("prose"),
        F.array_join(verdicts.gate_phrases(F.when(n % 3 == 0, F.concat(F.lit("Please Check  Access, "), name)).otherwise(name)), "|").alias("gates"),
    )


@query("""SELECT p_partkey AS page_id, 0 AS "table", unnest([0, 0, 1, 1])::INT AS "row", unnest([0, 1, 0, 1])::INT AS cell, unnest([p_type, 'a & b', p_size::VARCHAR, p_name || chr(10) || 'x']) AS text, unnest([true, true, false, false]) AS is_header, 1 AS rowspan, unnest([1, 2, 1, 1])::INT AS colspan FROM part""")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with one table for each part."""
    ship(spark)
    page = F.format_string('<body>z<table><tr><th>%s</th><th colspan="2">a &amp; b</th></tr><tr><td>%s</td><td rowspan="x">%s<br>x</td></tr></table><p>y</p>', F.col("p_type"), F.col("p_size"), F.col("p_name"))
    return tables.html_cells(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), page.alias("html")))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN 'p' || c_mktsegment END AS doi_provider, 'q' || c_mktsegment AS publisher_provider FROM customer""")
def route_by_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers by the registrant of a DOI and by the name of a publisher; of rules for one prefix the last counts."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    segment = rows.select("c_mktsegment").distinct()
    code = lambda c: (F.length(c) + 20 * F.ascii(c)).cast("string")
    prefixes = segment.select(F.concat(F.lit("p"), F.col("c_mktsegment")).alias("provider"), F.lit(2).alias("rank"), F.concat(F.lit("10."), code(F.col("c_mktsegment")), F.lit("/")).alias("prefix"))
    prefixes = prefixes.unionByName(prefixes.withColumn("provider", F.lit("old")).withColumn("rank", F.lit(1)))
    names = segment.select(F.concat(F.lit("q"), F.col("c_mktsegment")).alias("provider"), F.concat(F.col("c_mktsegment"), F.lit(" & Co")).alias("name"))
    doi = F.when(F.col("c_nationkey") % 5 == 0, F.concat(F.lit("doi:10."), code(F.col("c_mktsegment")), F.lit("/X"))).otherwise("10.9/x")
    asked = rows.withColumn("doi", doi).withColumn("publisher", F.concat(F.lower("c_mktsegment"), F.lit("  and co.")))
    return routing.by_publisher(routing.by_doi(asked, "doi", prefixes), "publisher", names).select("c_custkey", "doi_provider", "publisher_provider")


@query("""SELECT user_id, count(*) FILTER (event_type <> 'error') AS downloaded, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id""")
def asset_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.outcomes(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") != "error")


@query("""SELECT DISTINCT o_orderkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type IN ('error', 'click'))""")
def retry_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return assets.retryable(orders, table(spark, sf_dir, "events"), "user_id", ["error", "click"], "event_type").select("o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def sections_by_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return merge.semi(table(spark, sf_dir, "orders"), chosen, "o_custkey").select("o_orderkey")
