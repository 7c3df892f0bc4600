"""Queries over ordered rows: state, runs, budgets, prefixes, schedules, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import verdicts
from lectern.functions.text import token_estimate
from lectern.operators import ordered, sections
from lectern.plans.registry import query, table

_C = "SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations"


@query("""SELECT conv_id, turn, coalesce(last_value(CASE WHEN role <> 'assistant' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'none') AS state FROM conversations""")
def section_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    marker = F.when(F.col("role") != "assistant", F.col("role"))
    return ordered.carry_forward(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], marker, "state", "none").select("conv_id", "turn", "state")


@query("""WITH r AS (SELECT conv_id, role = 'assistant' AS m, length(text) AS n, sum(CASE WHEN role = 'assistant' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations),
s AS (SELECT conv_id, g, count(*) FILTER (m) AS c, coalesce(sum(n) FILTER (m), 0) AS z FROM r GROUP BY conv_id, g)
SELECT conv_id, max(c)::BIGINT AS run_rows, max(z)::BIGINT AS run_size FROM s GROUP BY conv_id""")
def longest_body_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.longest_run(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "assistant", F.length("text"))


_BUDGET = f"""WITH c AS ({_C}), t AS (SELECT *, ceil(length(text) / 4)::BIGINT AS tokens FROM c),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM t),
v AS (SELECT *, 200 - (upto - tokens) AS room, sum((upto > 200)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS over FROM u)"""


@query(f"{_BUDGET} SELECT conv_id, turn, tokens FROM v WHERE upto <= 200")
def budget_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return ordered.keep_in_budget(rows, ["conv_id"], ["turn"], "text", 200).where("NOT truncated").select("conv_id", "turn", "tokens")


@query(rf"""{_BUDGET} SELECT conv_id, turn, upto > 200 AS truncated, CASE WHEN upto <= 200 THEN text ELSE regexp_replace(left(text, greatest(32, 4 * room)::BIGINT), '[ ,;:\n]+$', '') || '...' END AS text FROM v WHERE upto <= 200 OR (over = 1 AND room > 64)""")
def budget_truncate_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return ordered.keep_in_budget(rows, ["conv_id"], ["turn"], "text", 200).select("conv_id", "turn", "truncated", "text")


@query("""WITH s AS (SELECT user_id, event_id, event_type, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM events)
SELECT user_id, event_id, event_type FROM s WHERE n = 0""")
def stop_after_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.before_first(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "event_type")


@query("""WITH s AS (SELECT conv_id, turn, max((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM conversations) SELECT conv_id, turn FROM s WHERE n = 0""")
def post_content_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.after_first(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "assistant").select("conv_id", "turn")


@query("""SELECT conv_id, turn, coalesce(bool_or(role = 'system') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM conversations""")
def seen_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.seen_before(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "system", "seen").select("conv_id", "turn", "seen")


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents")
def round_robin_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"])


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3")
def first_n_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.first_n(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], 3)


_MD = r"""WITH c AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '## Methods' WHEN role = 'system' THEN '# Abstract' ELSE '### Results' END || chr(10) || replace(coalesce(text, ''), '#', ''), chr(10) ORDER BY turn) AS md FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, unnest(string_split(md, chr(10))) AS line, unnest(range(len(string_split(md, chr(10))))) AS pos FROM c),
h AS (SELECT *, regexp_matches(line, '^#{1,6} ') AS head FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS section FROM h),
g AS (SELECT conv_id, section, max(CASE WHEN head THEN trim(regexp_replace(line, '^#+', '')) END) AS heading, max(CASE WHEN head THEN length(regexp_extract(line, '^#+')) END) AS level, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head) AS body FROM s GROUP BY conv_id, section)"""


@query(_MD + r""" SELECT conv_id, section::BIGINT AS section, heading, level::BIGINT AS level, CASE heading WHEN 'Abstract' THEN 'abstract' ELSE 'body' END AS kind, length(regexp_replace(coalesce(body, ''), '^[ \n]+|[ \n]+$', '', 'g'))::BIGINT AS chars FROM g WHERE regexp_replace(coalesce(body, ''), '[ \n]+', '', 'g') <> ''""")
def sections_from_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections.from_markdown(_markdown(spark, sf_dir), "conv_id", "md")
    return rows.select("conv_id", "section", "heading", "level", "kind", F.length("text").cast("long").alias("chars"))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("role") == "user", "## Methods").when(F.col("role") == "system", "# Abstract").otherwise("### Results")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(head, F.lit("\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("#"), F.lit(""))).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\n").alias("md"))


@query(_MD + r""", b AS (SELECT conv_id, section, heading, level, regexp_replace(coalesce(body, ''), '^[ \n]+|[ \n]+$', '', 'g') AS t FROM g WHERE regexp_replace(coalesce(body, ''), '[ \n]+', '', 'g') <> ''),
m AS (SELECT conv_id, greatest(0, min(level) - 2) AS shift FROM b GROUP BY conv_id)
SELECT conv_id, md5(string_agg(repeat('#', greatest(2, least(6, level - shift))::INT) || ' ' || heading || chr(10) || t, chr(10) || chr(10) ORDER BY section)) AS digest, sum(ceil(length(t) / 4))::BIGINT AS tokens FROM b JOIN m USING (conv_id) GROUP BY conv_id""")
def render_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections.from_markdown(_markdown(spark, sf_dir), "conv_id", "md")
    out = sections.render(rows, "conv_id")
    return out.select("conv_id", F.md5(F.col("markdown").cast("binary")).alias("digest"), "tokens")


@query(_MD + r""" SELECT heading, count(*)::BIGINT AS n, CASE heading WHEN 'Abstract' THEN 0 WHEN 'Methods' THEN 2 ELSE 3 END AS priority FROM g WHERE heading IS NOT NULL GROUP BY heading""")
def section_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections.lines(_markdown(spark, sf_dir), "conv_id", "md").where("head").groupBy("heading").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("heading", "n", verdicts.section_priority(F.col("heading")).alias("priority"))


@query(f"""WITH c AS ({_C}) SELECT conv_id, sum(CASE WHEN role = 'system' THEN ceil(length(text) / 4) ELSE 0 END)::BIGINT AS abstract, sum(CASE WHEN role = 'assistant' THEN ceil(length(text) / 4) ELSE 0 END)::BIGINT AS body, sum(CASE WHEN role = 'user' THEN ceil(length(text) / 4) ELSE 0 END)::BIGINT AS refs FROM c GROUP BY conv_id""")
def token_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = token_estimate(F.coalesce("text", F.lit("")))
    part = lambda role, name: F.sum(F.when(F.col("role") == role, n).otherwise(0)).cast("long").alias(name)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(part("system", "abstract"), part("assistant", "body"), part("user", "refs"))
