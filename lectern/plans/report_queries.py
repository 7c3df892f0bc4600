"""Queries over events and small dimensions: reports, retention, merges, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import merge, reports, retention, routing
from lectern.plans.registry import query, sql_host, sql_normalize, table

TYPES = ("view", "signup", "click", "error", "purchase")


@query("SELECT user_id, count(*) AS attempted, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS n_{t}" for t in TYPES) + """,
array_to_string(list_sort(list(event_id) FILTER (n <= 3)), ',') AS samples FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) GROUP BY user_id""")
def provider_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_summary(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", TYPES, "event_id")


_FLAGS = "list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN contains(lower(text), 'license') THEN 'licence' END, CASE WHEN contains(text, ' | ') THEN 'table' END], lambda x: x IS NOT NULL)"


def _flags() -> Column:
    marks = F.array(F.when(F.col("n_chars") < 200, "short"), F.when(F.contains(F.lower("text"), F.lit("license")), "licence"), F.when(F.contains("text", F.lit(" | ")), "table"))
    return F.filter(marks, lambda x: x.isNotNull())


@query(f"""WITH f AS (SELECT doc_id, unnest({_FLAGS}) AS issue_flag FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY issue_flag ORDER BY doc_id) AS k FROM f)
SELECT issue_flag, count(*) AS n, array_to_string(list_sort(list(doc_id) FILTER (k <= 5)), ',') AS samples FROM r GROUP BY issue_flag""")
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.issue_summary(table(spark, sf_dir, "documents").select("doc_id", _flags().alias("flags")), "flags", "doc_id")


@query(f"SELECT category, count(*) AS n FROM (SELECT unnest(CASE WHEN len({_FLAGS}) = 0 THEN ['ok'] ELSE {_FLAGS} END) AS category FROM documents) GROUP BY category")
def drift_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.category_counts(table(spark, sf_dir, "documents").select(_flags().alias("flags")), "flags")


_BENCH = "SELECT event_type AS backend, user_id % 3 AS run_kind, count(*) AS total, count(*) FILTER (value > 20) AS ok, round(avg((value > 20)::INT), 4) AS ok_rate, round(avg(value), 2) AS mean_ms FROM events GROUP BY ALL"


@query(_BENCH)
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("backend"), (F.col("user_id") % 3).alias("run_kind"), "value")
    return reports.benchmark_summary(rows, ["backend", "run_kind"], F.col("value") > 20, F.col("value"))


@query(f"SELECT backend AS winner FROM ({_BENCH}) WHERE run_kind = 0 ORDER BY ok_rate DESC, mean_ms, backend DESC LIMIT 1")
def benchmark_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.winner(benchmark_summary(spark, sf_dir).where("run_kind = 0"), "backend")


@query("SELECT user_id, string_agg(event_type, ' -> ' ORDER BY ts, event_id) AS trail FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id")
def trail_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.trail(table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase")), "user_id", ["ts", "event_id"], "event_type")


@query("""WITH r AS (SELECT user_id, event_type, event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 ELSE 9 END AS p FROM events)
SELECT user_id, arg_min(event_type, p::BIGINT * 1000000000 + event_id) AS event_type, string_agg(event_type, '; ' ORDER BY event_id) AS messages FROM r GROUP BY user_id""")
def worst_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("said", F.col("event_type"))
    return reports.worst_failure(rows, "user_id", "event_type", {"error": 0, "signup": 1}, "said", "event_id")


@query("SELECT CASE WHEN bool_or(event_type = 'error') THEN 3 WHEN bool_or(event_type = 'signup') THEN 2 ELSE 0 END AS exit_code FROM events")
def batch_exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.exit_code(table(spark, sf_dir, "events"), "event_type", [("error", 3), ("signup", 2)])


@query("""SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') > 25 THEN 'error' WHEN count(*) FILTER (event_type = 'signup') > 0 AND count(*) FILTER (event_type = 'purchase') = 0 THEN 'rate_limited'
WHEN count(*) FILTER (event_type = 'purchase') = count(*) THEN 'ready' WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'partial' ELSE 'not_configured' END AS status FROM events GROUP BY user_id""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.functions.verdicts import status_rollup as rollup

    n = lambda t: F.count_if(F.col("event_type") == t)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(rollup(F.greatest(n("error") - 25, F.lit(0)), n("signup"), n("purchase"), F.count(F.lit(1))).alias("status"))


@query("""WITH a AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS t, round(value * 100)::BIGINT AS b FROM events),
n AS (SELECT *, max(t) OVER (PARTITION BY user_id) AS now FROM a), x AS (SELECT * FROM n WHERE now - t <= 604800),
y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS k FROM x),
z AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM y WHERE k <= 40) SELECT user_id, event_id FROM z WHERE s <= 60000""")
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"), F.round(F.col("value") * 100).cast("long").alias("b"))
    now = rows.groupBy("user_id").agg(F.max("t").alias("now"))
    return retention.prune(rows.join(now, "user_id"), "t", "b", ["event_id"], F.col("now"), 604800, 40, 60000, ["user_id"]).select("user_id", "event_id")


@query("SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def newest_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.newest_per_kind(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", ["event_id"])


@query("""WITH f AS (SELECT user_id, event_id, 1 AS fresh FROM events WHERE event_type = 'purchase'), i AS (SELECT user_id, event_id, 0 AS fresh FROM events WHERE event_type = 'view')
SELECT * FROM i WHERE user_id NOT IN (SELECT user_id FROM f) UNION ALL SELECT * FROM f""")
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    index, new = e.where("event_type = 'view'").select("user_id", "event_id", F.lit(0).alias("fresh")), e.where("event_type = 'purchase'").select("user_id", "event_id", F.lit(1).alias("fresh"))
    return merge.upsert(index, new, "user_id")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN (props->>'$.k')::BIGINT >= 50 THEN 'blocking' ELSE 'positive' END AS signal FROM events")
def json_rule_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.when(k >= 50, "blocking").otherwise("positive").alias("signal"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, nullif(d.lang, '') AS lang, l.quality, coalesce(d.n_chars, 0) AS n_chars FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id")
def merge_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(None).cast("int").alias("quality"), "n_chars")
    other = table(spark, sf_dir, "labels").select("doc_id", F.lit(None).cast("string").alias("lang"), "quality", F.lit(0).cast("long").alias("n_chars"))
    return merge.merge_pair(d, other, "doc_id", ["lang", "quality", "n_chars"])


@query("""WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS p FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY p) AS kinds FROM f GROUP BY user_id""")
def merge_concat_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("p"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


@query("""SELECT user_id, arg_min(event_type, (CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END)::BIGINT * 1000000000 + event_id) AS picked FROM events GROUP BY user_id""")
def select_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "click", "unknown").otherwise("negative")
    rows = table(spark, sf_dir, "events").withColumn("state", state)
    best = routing.select_probe(rows, "user_id", "state", "event_id").select("user_id", "event_id")
    return best.join(rows, ["user_id", "event_id"]).select("user_id", F.col("event_type").alias("picked"))


@query("""WITH s AS (SELECT user_id, event_id, event_type, coalesce(max((event_type IN ('purchase', 'error'))::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM events)
SELECT user_id, event_id FROM s WHERE ended = 0 AND event_type = 'purchase'""")
def waterfall_first_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") == "purchase").withColumn("goes_on", F.col("event_type") != "error")
    return routing.waterfall(rows, "user_id", "event_id", "ok", "goes_on").select("user_id", "event_id")


#: Routing rules for the pages: provider, rank, domain.
RULES = [("first", 1, "example.com"), ("second", 2, "example.org"), ("third", 3, "example.net")]


@query(f"""WITH r(provider, rank, domain) AS (VALUES {', '.join(map(str, RULES))}), p AS (SELECT page_id, {sql_host('url')} AS host FROM pages)
SELECT page_id, arg_min(provider, rank) AS provider FROM p LEFT JOIN r ON host = domain OR ends_with(host, '.' || domain) GROUP BY page_id""")
def route_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "provider string, rank int, domain string")
    return routing.by_domain(table(spark, sf_dir, "pages"), "url", "page_id", rules).select("page_id", "provider")


@query(f"""WITH s AS (SELECT page_id, 'example' AS provider, 1 AS rank, 'domain' AS signal FROM pages WHERE ends_with({sql_host('url')}, 'example.com')
UNION ALL SELECT page_id, 'example', 2, 'publisher' FROM pages UNION ALL SELECT page_id, 'other', 3, 'doi' FROM pages WHERE contains(html, 'lang="en"')),
u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY page_id, provider ORDER BY rank) = 1)
SELECT page_id, provider, signal, row_number() OVER (PARTITION BY page_id ORDER BY rank) AS place FROM u""")
def route_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.functions.ids import host

    p = table(spark, sf_dir, "pages")
    one = lambda rows, name, rank, signal: rows.select("page_id", F.lit(name).alias("provider"), F.lit(rank).alias("rank"), F.lit(signal).alias("signal"))
    signals = one(p.where(F.endswith(host(F.col("url")), F.lit("example.com"))), "example", 1, "domain").unionByName(one(p, "example", 2, "publisher")).unionByName(one(p.where(F.contains("html", F.lit('lang="en"'))), "other", 3, "doi"))
    return routing.candidates(signals, "page_id").select("page_id", "provider", "signal", "place")


@query(f"""WITH d AS (SELECT source, doc_id, n_chars, CASE WHEN lang = 'fr' THEN '' ELSE lang END AS lang, md5({sql_normalize('text')}) AS h FROM documents)
SELECT source, h, min(doc_id) AS doc_id, arg_min(lang, doc_id) FILTER (lang <> '') AS lang FROM d GROUP BY source, h""")
def merge_by_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.functions.text import normalize_text

    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.when(F.col("lang") == "fr", "").otherwise(F.col("lang")).alias("lang"), F.md5(normalize_text(F.col("text")).cast("binary")).alias("h"))
    return merge.merge_by_identity(rows, ["source"], "h", "doc_id", ["lang"])
