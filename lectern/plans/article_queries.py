"""Queries over assets and whole articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import articles, assets, sections
from lectern.plans.ordered_queries import _MD, _markdown
from lectern.plans.registry import query, sql_words, table

@query("""WITH w AS (SELECT p_name AS k, min('10.1/p' || p_partkey) AS doi FROM part GROUP BY p_name HAVING count(*) = 1)
SELECT p.p_partkey AS id, unnest(['doi: 10.1234/AB' || p.p_partkey, 'https://x.org/' || p.p_partkey, upper(p.p_name), ' ']) AS query, unnest(['doi', 'url', 'title', 'empty']) AS kind, unnest(['10.1234/ab' || p.p_partkey, NULL, w.doi, NULL]) AS doi
FROM part p LEFT JOIN w ON p.p_name = w.k""")
def resolve_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four queries for each part; the title resolves where one part alone has it."""
    part, n = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    works = part.select(F.concat(F.lit("10.1/p"), n).alias("doi"), F.col("p_name").alias("title_key"))
    asked = part.select(F.col("p_partkey").alias("id"), F.explode(F.array(F.concat(F.lit("doi: 10.1234/AB"), n), F.concat(F.lit("https://x.org/"), n), F.upper("p_name"), F.lit(" "))).alias("query"))
    return articles.resolve(asked, works)


@query("""WITH e AS (SELECT DISTINCT user_id, event_type FROM events) SELECT user_id, concat_ws(',', max(CASE WHEN event_type = 'purchase' THEN 'purchase' END), max(CASE WHEN event_type = 'click' THEN 'click' END)) AS evidence,
CASE WHEN bool_or(event_type IN ('purchase', 'click')) THEN 'likely_yes' ELSE 'unknown' END AS state FROM e GROUP BY user_id""")
def probe_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = articles.probe(table(spark, sf_dir, "events"), "user_id", ["purchase", "click"], "event_type")
    return out.select("user_id", F.array_join("evidence", ",").alias("evidence"), "state")


_ARTICLE = (
    _MD
    + rf""", b AS (SELECT conv_id, section, heading, regexp_replace(coalesce(body, ''), '^[ \n]+|[ \n]+$', '', 'g') AS t FROM g WHERE regexp_replace(coalesce(body, ''), '[ \n]+', '', 'g') <> ''),
a AS (SELECT conv_id, arg_min(t, section) FILTER (heading = 'Abstract') AS abstract, coalesce(sum(length(t)) FILTER (heading <> 'Abstract'), 0) AS chars, coalesce(sum({sql_words('t')}) FILTER (heading <> 'Abstract'), 0) AS words, count(*) FILTER (heading <> 'Abstract') AS blocks FROM b GROUP BY conv_id)"""
)


@query(
    _ARTICLE
    + """ SELECT conv_id, chars::BIGINT AS body_chars, words::BIGINT AS body_words, blocks AS body_blocks, CASE WHEN chars >= 300 AND words >= 60 THEN 'fulltext' WHEN coalesce(abstract, '') <> '' THEN 'abstract_only' ELSE 'metadata_only' END AS content_kind,
CASE WHEN NOT (chars >= 300 AND words >= 60) THEN 'low' WHEN blocks < 2 THEN 'medium' ELSE 'high' END AS confidence FROM a"""
)
def article_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles.assemble(sections.from_markdown(_markdown(spark, sf_dir), "conv_id", "md"), "conv_id")
    out = articles.assess(rows.withColumn("signals", F.array().cast("array<string>")).withColumn("losses", F.lit(0)))
    return out.select("conv_id", "body_chars", "body_words", "body_blocks", "content_kind", "confidence")


@query(
    _ARTICLE
    + """ SELECT conv_id, '{"conv_id":' || conv_id || ',"body_words":' || words::BIGINT || ',"body_blocks":' || blocks || '}' AS json FROM a"""
)
def envelope_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles.assemble(sections.from_markdown(_markdown(spark, sf_dir), "conv_id", "md"), "conv_id")
    return rows.select("conv_id", F.to_json(F.struct("conv_id", "body_words", "body_blocks")).alias("json"))


@query("""WITH r AS (SELECT user_id, event_id, (value * 10)::BIGINT AS size FROM events WHERE round(value * 10) <= 500), n AS (SELECT user_id, event_id, round(value * 10)::BIGINT AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE round(value * 10) <= 500),
t AS (SELECT *, sum(size) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS total FROM n WHERE k <= 10) SELECT user_id, event_id FROM t WHERE total <= 1500""")
def asset_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") * 10).cast("long").alias("size"))
    return assets.within_budget(rows, ["user_id"], ["event_id"], "size", 10, 500, 1500).select("user_id", "event_id")


@query("""SELECT c_custkey AS doc, unnest([0, 1, 2, 3])::INT AS pos, unnest(['n' || c_nationkey || '.png', 'n' || c_nationkey || '_2.png', 'b_c', 'n' || c_nationkey || '_3.png']) AS file FROM customer""")
def asset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey").cast("string")
    urls = F.array(F.concat(F.lit("http://x/N"), n, F.lit(".png")), F.concat(F.lit("http://y/n"), n, F.lit(".png?z")), F.lit("http://y/b%c"), F.concat(F.lit("http://x/n"), n, F.lit(".png")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.posexplode(urls).alias("pos", "url"))
    return assets.unique_names(rows, ["doc"], "url", "pos").select("doc", "pos", "file")


@query("""SELECT * FROM (SELECT doc_id, unnest(['r1', 'r2', 'r3', 'r4']) AS rule, unnest([CASE WHEN NOT contains(text, 'the') THEN 'missing' END, CASE WHEN contains(text, 'on ') THEN 'forbidden' END,
CASE WHEN NOT regexp_matches(text, '^[A-Z]') THEN 'no_match' END, CASE WHEN len(regexp_extract_all(text, 'th')) <> 5 THEN 'wrong_count' END]) AS problem FROM documents) WHERE problem IS NOT NULL""")
def markdown_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = lambda name, kind, pattern, n: F.struct(F.lit(name).alias("rule"), F.lit(kind).alias("kind"), F.lit(pattern).alias("pattern"), F.lit(n).alias("n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = docs.select("doc_id", F.explode(F.array(rule("r1", "include", "the", 0), rule("r2", "exclude", "on ", 0), rule("r3", "regex", "^[A-Z]", 0), rule("r4", "count", "th", 5))).alias("r")).select("doc_id", "r.*")
    return articles.contract_issues(docs, rules, "doc_id", "text")


@query("""SELECT s.doc_id, s.quality AS quality, 1 AS expected FROM labels s WHERE s.quality IS DISTINCT FROM 1""")
def manifest_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return articles.expected_vs_actual(labels, labels.select("doc_id", F.lit(1).alias("quality")), "doc_id", "quality")


@query("""WITH r AS (SELECT *, starts_with(lower(trim(text)), 'a') AS m FROM conversations), f AS (SELECT *, max((NOT m)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS begun FROM r),
c AS (SELECT *, max((m AND begun = 1)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS cut FROM f) SELECT conv_id, turn FROM c WHERE cut = 0 AND NOT m""")
def stop_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.stop_markers(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", ["a"]).select("conv_id", "turn")
