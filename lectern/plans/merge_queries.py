"""Queries over layered records, retries, shown assets, sections and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import articles, assets, merge, references, reports, retention, sections
from lectern.plans.registry import query, table


@query("""WITH l AS (SELECT c_custkey, unnest([1, 2, 3]) AS r, unnest([CASE WHEN c_nationkey % 2 = 0 THEN ' ' ELSE c_name END, c_mktsegment, 'z']) AS title, unnest(['a', c_name, CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE 'last' END]) AS venue FROM customer)
SELECT c_custkey, arg_min(title, r) FILTER (trim(title) <> '') AS title, arg_max(venue, r) FILTER (trim(venue) <> '') AS venue, any_value(words) AS words FROM l JOIN (SELECT c_custkey, c_name || '|Bo|x' AS words FROM customer) USING (c_custkey) GROUP BY c_custkey""")
def layered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers for each customer: the first title, the last venue, all words once whatever their case."""
    c, n, s = F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")
    layer = lambda r, title, venue, words: F.struct(F.lit(r).alias("r"), title.alias("title"), venue.alias("venue"), F.array(*words).alias("words"))
    held = [layer(1, F.when(n % 2 == 0, " ").otherwise(c), F.lit("a"), [c, F.lit("Bo")]), layer(2, s, c, [F.lit("BO"), F.lit("")]), layer(3, F.lit("z"), F.when(n % 3 == 0, "").otherwise("last"), [F.upper(c), F.lit("x")])]
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*held)).alias("l")).select("c_custkey", "l.*")
    return merge.merge_layers(rows, "c_custkey", "r", ["title"], ["venue"], ["words"]).withColumn("words", F.array_join("words", "|"))


@query("""WITH f AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), r AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT user_id, 'first' AS run FROM f WHERE user_id NOT IN (SELECT user_id FROM r) UNION ALL SELECT DISTINCT user_id, 'retry' FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM f) AND user_id % 2 = 0""")
def open_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with an error and no purchase, and of those with both every other one, whose retry failed too."""
    e = table(spark, sf_dir, "events")
    users = lambda t: e.where(F.col("event_type") == t).select("user_id").distinct()
    failed, retried = users("error"), users("purchase")
    again = retried.join(failed, "user_id", "left_semi").where("user_id % 2 = 0").withColumn("run", F.lit("retry"))
    return merge.unresolved_failures(failed.withColumn("run", F.lit("first")), retried, again, "user_id")


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.last_write(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["value", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""SELECT o_orderkey, 'http://x/' || o_custkey AS url FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0)""")
def assets_not_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as assets of one document, less those whose address the document shows."""
    address = lambda c: F.concat(F.lit("http://x/"), F.col(c).cast("string")).alias("url")
    rows = table(spark, sf_dir, "orders").select(F.lit(1).alias("doc"), "o_orderkey", address("o_custkey"))
    shown = table(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").select(F.lit(1).alias("doc"), address("c_custkey"))
    return references.drop_shown(rows, shown, "doc").select("o_orderkey", "url")


@query("""SELECT p_partkey, caption FROM (SELECT p_partkey, unnest(['Fig ' || upper(p_name), p_brand, '']) AS caption, p_name FROM part) WHERE NOT (caption <> '' AND caption LIKE 'Fig %')""")
def captions_not_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.explode(F.array(F.concat(F.lit("Fig "), F.upper("p_name")), F.col("p_brand"), F.lit(""))).alias("caption"))
    bodies = part.select("p_partkey", F.concat(F.lit("See the **fig. "), F.col("p_name"), F.lit("** here")).alias("body"))
    return assets.drop_repeated_captions(rows, bodies, "p_partkey")


@query("""SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3""")
def first_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.limit_references(table(spark, sf_dir, "conversations").withColumnRenamed("turn", "pos"), "conv_id", "top", 3).select("conv_id", F.col("pos").alias("turn"))


@query("""WITH s AS (SELECT p_partkey, unnest([1, 2, 3, 4]) AS section, unnest(['A', 'B', 'C', 'D']) AS heading, unnest([2, 3, 2, 2]) AS level, unnest(['', p_name, ' ', CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END]) AS text, unnest(['body', 'abstract', 'body', 'body']) AS kind FROM part),
k AS (SELECT * FROM s WHERE (trim(text) <> '' OR section = 1))
SELECT p_partkey, section, heading FROM k JOIN (SELECT p_partkey, p_size FROM part) USING (p_partkey) WHERE p_size % 3 = 0 OR (p_size % 3 = 1 AND kind = 'abstract')""")
def downgraded_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each part that can be shown, and of these what its target kind leaves."""
    part, size = table(spark, sf_dir, "part"), F.col("p_size")
    section = lambda n, heading, level, text, kind: F.struct(F.lit(n).alias("section"), F.lit(heading).alias("heading"), F.lit(level).alias("level"), text.alias("text"), F.lit(kind).alias("kind"))
    held = [section(1, "A", 2, F.lit(""), "body"), section(2, "B", 3, F.col("p_name"), "abstract"), section(3, "C", 2, F.lit(" "), "body"), section(4, "D", 2, F.when(size % 2 == 0, F.col("p_type")).otherwise(""), "body")]
    rows = part.select("p_partkey", F.explode(F.array(*held)).alias("s")).select("p_partkey", "s.*")
    targets = part.select("p_partkey", F.when(size % 3 == 0, "fulltext").when(size % 3 == 1, "abstract_only").otherwise("metadata_only").alias("target"))
    return articles.downgrade(sections.renderable(rows, "p_partkey"), targets, "p_partkey").select("p_partkey", "section", "heading")


@query("""SELECT doc_id, CASE WHEN ceil(length(text) / 4) <= b - 8 THEN text WHEN b > 16 THEN rtrim(substr(text, 1, 4 * (b - 16)), ' ') || '...' ELSE '' END AS abstract FROM (SELECT doc_id, text, (10 + doc_id % 50)::INT AS b FROM documents WHERE length(text) > 0)""")
def abstract_in_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as abstracts, in budgets of 10 to 59 tokens."""
    rows = table(spark, sf_dir, "documents").where("length(text) > 0")
    return rows.select("doc_id", articles.abstract_in_budget(F.col("text"), 8, (F.lit(10) + F.col("doc_id") % 50).cast("int")).alias("abstract"))


@query("""SELECT user_id, string_agg(event_type || '=' || printf('%.2f', s), ',' ORDER BY event_type) AS stages FROM (SELECT user_id, event_type, sum(value) AS s FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
def stage_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.stage_seconds(table(spark, sf_dir, "events"), "user_id", "event_type", "value")
    said = F.transform(F.map_entries("stages"), lambda x: F.concat(x["key"], F.lit("="), F.format_string("%.2f", x["value"])))
    return rows.select("user_id", F.array_join(said, ",").alias("stages"))


@query("""SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase' AND value > 10) AS large FROM events""")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(table(spark, sf_dir, "events"), {"failed": F.col("event_type") == "error", "large": (F.col("event_type") == "purchase") & (F.col("value") > 10)})


@query("""SELECT o_custkey, count(DISTINCT o_orderstatus || o_orderpriority) AS signatures FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus || o_orderpriority) > 1""")
def unstable_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.unstable(table(spark, sf_dir, "orders"), "o_custkey", F.concat("o_orderstatus", "o_orderpriority"))


@query("""SELECT event_id, age <= 86400 * 10 AS fresh FROM (SELECT event_id, (epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)))::BIGINT AS age FROM events)""")
def cache_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.unix_timestamp(F.lit("2024-02-01 00:00:00"))
    return table(spark, sf_dir, "events").select("event_id", retention.fresh(F.unix_timestamp(F.col("ts").cast("timestamp")), now, 86400 * 10).alias("fresh"))
