"""Queries over outcomes of requests and results, and over the scalars of headings, links, labels and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import marks, outcomes
from lectern.plans.registry import query, table


@query("""SELECT o_orderkey, status, CASE WHEN status IN (401, 403) THEN 'no_access' WHEN status = 404 THEN 'no_result' WHEN status = 429 THEN 'rate_limited' ELSE 'error' END AS code
FROM (SELECT o_orderkey, [400, 401, 403, 404, 406, 422, 429, 500, 503][o_orderkey % 9 + 1] AS status FROM orders)""")
def http_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, (400, 401, 403, 404, 406, 422, 429, 500, 503))), (F.col("o_orderkey") % 9).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status")).withColumn("code", outcomes.http_failure(F.col("status")))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'timeout' WHEN event_type = 'signup' THEN 'tls_error' WHEN user_id % 4 = 0 THEN 'connection_reset' WHEN user_id % 4 = 1 THEN 'connection_closed' WHEN user_id % 4 = 2 THEN 'dns_error' ELSE 'network_error' END AS category FROM events""")
def network_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.get(F.array(*map(F.lit, ("Connection RESET by peer", "remote end closed", "Temporary failure in name resolution", "odd"))), (F.col("user_id") % 4).cast("int"))
    kinds = F.when(F.col("event_type") == "error", F.array(F.lit("dns"), F.lit("timeout"))).when(F.col("event_type") == "signup", F.array(F.lit("tls"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select("event_id", outcomes.network_error(kinds, said).alias("category"))


@query("""WITH t AS (SELECT user_id, list(DISTINCT event_type) AS e, user_id % 5 = 0 AS full_text FROM events GROUP BY user_id),
s AS (SELECT *, CASE WHEN full_text THEN 'fulltext' WHEN list_contains(e, 'error') THEN 'rate_limited' WHEN list_contains(e, 'signup') THEN 'no_result' ELSE 'metadata_only' END AS status FROM t)
SELECT user_id, status, CASE WHEN status <> 'fulltext' THEN 'blocked' WHEN list_contains(e, 'purchase') THEN 'issue' ELSE 'ok' END AS review,
CASE WHEN list_contains(e, 'purchase') THEN 'rerun live later or update access review/runtime after operator inspection' WHEN list_contains(e, 'click') THEN 'repair provider route-source handling before accepting live drift' ELSE 'none' END AS action FROM s""")
def result_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, review and advice of each user's trail of events."""
    step = F.when(F.col("event_type") == "error", "fulltext:p_rate_limited").when(F.col("event_type") == "signup", "fulltext:p_fail").otherwise("other")
    category = F.when(F.col("event_type") == "purchase", "access_gate").when(F.col("event_type") == "click", "source_mismatch")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(step).alias("trail"), F.collect_set(category).alias("found"))
    kind = F.when(F.col("user_id") % 5 == 0, "fulltext").otherwise("none")
    rows = rows.withColumn("status", outcomes.result_status(F.lit("p"), kind, F.col("trail")))
    issues = F.filter("found", lambda x: x == "access_gate")
    return rows.select("user_id", "status", outcomes.review_status(F.col("status"), issues).alias("review"), outcomes.operator_action(F.col("found")).alias("action"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 100000 AND o_orderstatus <> 'F' THEN 'fulltext' WHEN o_custkey % 2 = 0 THEN 'abstract_only' ELSE 'metadata_only' END AS kind,
NOT (o_custkey % 3 = 0) AND o_totalprice >= 500 AND o_totalprice >= 3 * o_custkey AS retry, CASE WHEN o_custkey % 3 = 0 THEN 'asked' WHEN o_orderstatus = 'F' THEN 'captions_only' ELSE 'inline' END AS figures,
o_orderstatus = 'O' AS supplementary, coalesce(CASE WHEN o_custkey % 3 = 0 THEN 'body' END, CASE WHEN o_custkey % 3 = 1 THEN 'none' END, 'all') AS profile, o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT', '2-HIGH') AS allowed FROM orders""")
def fetch_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col("o_custkey"), F.col("o_orderstatus")
    price, third = F.col("o_totalprice"), F.col("o_custkey") % 3
    profile = F.when(s == "F", "none").when(s == "O", "all").otherwise("body")
    listed = F.when(s != "F", F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        outcomes.diagnostic_kind(price > 100000, c % 2 == 0, s == "F").alias("kind"),
        outcomes.transparent_fallback(third == 0, c, price, price).alias("retry"),
        outcomes.figure_mode(F.when(third == 0, "asked"), profile).alias("figures"),
        outcomes.supplementary_mode(F.lit(None).cast("boolean"), profile).alias("supplementary"),
        outcomes.asset_profile(F.when(third == 0, "body"), F.when(third == 1, "none"), F.lit("all")).alias("profile"),
        outcomes.allowed(F.col("o_orderpriority"), listed).alias("allowed"),
    )


_WARN = "list_filter([" + ", ".join(f"CASE WHEN {' + '.join(f'{n}' for n in names)} > 0 THEN '{said}' END" for names, said in outcomes.LOSSES) + "], lambda x: x IS NOT NULL)"


@query(f"""SELECT p_partkey, array_to_string({_WARN}, '|') AS warnings FROM (SELECT p_partkey, p_size % 2 AS table_fallback, p_size % 3 // 2 AS table_semantic_loss, p_size % 5 // 4 AS table_lossy, p_size % 7 // 6 AS table_layout_degraded, p_partkey % 2 AS formula_fallback, p_partkey % 3 // 2 AS formula_missing FROM part)""")
def loss_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = lambda c, n: ((F.col(c) % n) == n - 1).cast("int")
    counts = {"table_fallback": last("p_size", 2), "table_semantic_loss": last("p_size", 3), "table_lossy": last("p_size", 5), "table_layout_degraded": last("p_size", 7), "formula_fallback": last("p_partkey", 2), "formula_missing": last("p_partkey", 3)}
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(outcomes.loss_warnings(counts), "|").alias("warnings"))


@query("""SELECT p_partkey, CASE WHEN own THEN p_size ELSE 7 END::INT AS chars, CASE WHEN own THEN false OR p_size % 2 = 0 ELSE p_size % 2 = 0 END AS explicit, CASE WHEN own THEN greatest(p_size % 4, 2) ELSE 2 END::INT AS figures
FROM (SELECT *, p_partkey % 3 > 0 AS own FROM part)""")
def merged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, own = F.col("p_size"), F.col("p_partkey") % 3 > 0
    mine = dict.fromkeys(("chars", "words", "blocks", "headings"), F.when(own, size).otherwise(0)) | {"figures": F.when(own, size % 4).otherwise(0), "explicit": F.lit(False), "post_abstract": F.lit(False)}
    theirs = dict.fromkeys(("chars", "words", "blocks", "headings"), F.lit(7)) | {"figures": F.lit(2), "explicit": size % 2 == 0, "post_abstract": F.lit(False)}
    out = outcomes.merged_metrics(mine, theirs)
    return table(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", out["chars"].cast("int").alias("chars"), out["explicit"].alias("explicit"), out["figures"].cast("int").alias("figures"))


@query("""SELECT p_partkey, '---' || chr(10) || 'title: "a ''' || p_name || '''"' || chr(10) || CASE WHEN p_size % 2 = 0 THEN 'journal: "' || p_brand || '"' || chr(10) ELSE '' END || 'source: "' || p_type || '"' || chr(10)
|| 'has_fulltext: ' || (p_size > 20) || chr(10) || 'content_kind: "' || CASE WHEN p_size > 20 THEN 'fulltext' ELSE 'abstract_only' END || '"' || chr(10) || 'has_abstract: true' || chr(10) || 'token_estimate: ' || p_size || chr(10) || '---' || chr(10) || chr(10) || '# a "' || p_name || '"' || chr(10) AS header FROM part""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"title": F.concat(F.lit('a  "'), F.col("p_name"), F.lit('"')), "journal": F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), "doi": F.lit(None).cast("string")}
    kind = F.when(F.col("p_size") > 20, "fulltext").otherwise("abstract_only")
    return table(spark, sf_dir, "part").select("p_partkey", outcomes.front_matter(fields, F.col("p_type"), kind, F.lit(True), F.col("p_size")).alias("header"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Text' ELSE '# ' || upper(p_name) || '!' || chr(10) || chr(10) || 'Text' END AS body, p_name || ' two' || chr(10) || chr(10) || 'b' AS prose, p_name || chr(10) || chr(10) || 'x' || chr(10) AS lines,
regexp_replace(p_name, '[^a-z0-9]', '', 'g') || 'h2o' AS caption, 'H₂O' || p_size || 'SO₄²⁻' AS formula FROM part""")
def markdown_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, even = F.col("p_name"), F.col("p_size") % 2 == 0
    heading = F.concat(F.lit("# "), F.upper(name), F.lit("!\n\nText"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        marks.without_title(heading, F.when(even, name).otherwise("other")).alias("body"),
        marks.joined_lines(F.concat(name, F.lit(" \n two\n \n\n  b"))).alias("prose"),
        marks.plain_lines(F.concat(name, F.lit("  \n \n\n\nx \n\n"))).alias("lines"),
        marks.caption_key(F.concat(F.lit("![a](b.png) **"), name, F.lit("** H<sub>2</sub>O"))).alias("caption"),
        marks.chemistry(F.concat(F.lit("H<sub>2</sub>O"), F.col("p_size").cast("string"), F.lit("SO<SUB>4</SUB><sup>2-</sup>"))).alias("formula"),
    )


@query("""SELECT page_id, page_id % 2 = 0 AS reference, page_id % 3 = 0 AS supplement, page_id % 4 = 0 AS full_size, CASE page_id % 4 WHEN 0 THEN 'Figure ' || page_id || 'b' WHEN 1 THEN 'Table S' || page_id WHEN 2 THEN 'Formula' ELSE 'Figure' END AS alt,
url AS target, CASE WHEN page_id % 2 = 0 THEN '10.3390/s' || page_id || '03' || CASE WHEN page_id < 1000 THEN lpad((page_id)::VARCHAR, 4, '0') ELSE page_id::VARCHAR END END AS doi FROM pages""")
def link_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("page_id").cast("string"), F.col("page_id")
    kind = F.get(F.array(*map(F.lit, ("Figure", "table", "equation", "figure"))), (k % 4).cast("int"))
    heading = F.when(k % 4 == 0, F.concat(F.lit("Fig. "), n, F.lit("b shows"))).when(k % 4 == 1, F.concat(F.lit("TABLE S"), n)).otherwise("none")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        marks.is_reference_href(F.concat(F.lit("/a.html#"), F.when(k % 2 == 0, F.lit("bib")).otherwise("fig"), n)).alias("reference"),
        marks.is_supplement(F.when(k % 3 == 1, "#top.pdf").otherwise(F.concat(F.lit("/f"), n)), F.when(k % 3 == 2, "Home").otherwise("Supplementary  file")).alias("supplement"),
        marks.is_full_size(F.concat(F.when(k % 4 == 0, F.lit("http://x/Large/")).when(k % 4 == 1, F.lit("http://x/large/thumbnail/")).otherwise(F.lit("http://x/")), n)).alias("full_size"),
        marks.image_alt(kind, heading, F.lit(None).cast("string")).alias("alt"),
        marks.refresh_target(F.concat(F.lit("5; URL='"), F.col("url"), F.lit("'"))).alias("target"),
        marks.journal_doi(F.concat(F.lit("https://www.mdpi.com/"), F.when(k % 2 == 0, "1424-8220").otherwise("0000-0000"), F.lit("/"), n, F.lit("/3/"), n)).alias("doi"),
    )


@query("""SELECT c_custkey, array_to_string([c_name, 'Bo Li'], '|') AS authors, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_nationkey END::BIGINT AS n, c_nationkey % 2 = 0 AS usable, c_nationkey % 4 = 1 AS mixed,
c_mktsegment AS first, c_nationkey % 2 = 0 AS subset, array_to_string([c_mktsegment, 'x', 'y'], '|') AS together, 'y' AS minus FROM customer""")
def list_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey")
    number = F.when(n % 3 == 0, F.concat(F.lit("-"), (n + 1).cast("string"))).otherwise(F.concat(F.lit(" "), n.cast("string")))
    refs = F.concat(F.lit("# Paper\n\n## References (2)\n\n1. One\n"), F.when(n % 4 == 1, "- Two\n").when(n % 4 == 2, "## End\n- Two\n").otherwise("[2] Two\n"))
    names = F.array(F.col("c_name"), F.lit("Li, Bo"), F.upper("c_name"), F.lit(" "), F.lit("bo  LI"))
    authors = F.transform(marks.distinct_authors(names), lambda a: F.when(a == "Li, Bo", "Bo Li").otherwise(a))
    both = F.array("c_mktsegment", F.lit("x"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.array_join(authors, "|").alias("authors"),
        marks.count_or_null(number).alias("n"),
        marks.usable_title(F.when(n % 2 == 0, F.col("c_name")).otherwise("Just a  moment ..."), 3).alias("usable"),
        marks.mixes_reference_lists(refs).alias("mixed"),
        marks.first_item(both).alias("first"),
        marks.is_subset(F.array(F.when(n % 2 == 0, F.lit("x")).otherwise("z")), both).alias("subset"),
        F.array_join(F.array_union(both, F.array(F.lit("x"), F.lit("y"))), "|").alias("together"),
        F.array_join(F.array_except(F.array(F.lit("x"), F.lit("y")), both), "|").alias("minus"),
    )


@query("""WITH a AS (SELECT user_id, event_type, sum(value) AS v FROM events WHERE user_id % 2 = 0 GROUP BY ALL), e AS (SELECT event_type, sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS before, sum(CASE WHEN user_id % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS after FROM events GROUP BY event_type)
SELECT event_type, after - before AS delta FROM e""")
def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of two snapshots, joined in full so that one side's counters count from or to 0."""
    e = table(spark, sf_dir, "events")
    snap = lambda odd, name: e.where(F.col("user_id") % 2 == odd).groupBy("event_type").agg(F.count(F.lit(1)).alias(name))
    rows = snap(0, "before").join(snap(1, "after"), "event_type", "full_outer")
    return rows.select("event_type", (F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("delta"))


@query("""SELECT conv_id, list(turn ORDER BY length(text) DESC, turn)[1:5]::VARCHAR AS best FROM conversations GROUP BY conv_id""")
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five longest turns of each conversation, ties in the order of the turns."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct((-F.length("text")).alias("score"), F.col("turn").alias("turn")))).alias("all"))
    return rows.select("conv_id", F.concat(F.lit("["), F.array_join(F.transform(F.slice("all", 1, 5), lambda x: x["turn"].cast("string")), ", "), F.lit("]")).alias("best"))
