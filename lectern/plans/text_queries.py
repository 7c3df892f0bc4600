"""Queries over document texts: scalars, gates, duplicates, overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import ids, text, verdicts
from lectern.operators import similarity
from lectern.plans.registry import query, sql_collapse, sql_normalize, sql_words, table


@query(f"SELECT doc_id, {sql_normalize('text')} AS clean FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("clean"))


@query(f"""SELECT doc_id, {sql_words('text')} AS words, len(list_filter(regexp_split_to_array(text, '[ \t\n]+'), lambda x: x <> ''))::BIGINT AS spaced,
len(regexp_extract_all(text, '[.!?]+(?:[ \t\n]|$)'))::BIGINT AS sentences, ceil(length(text) / 4)::BIGINT AS tokens, length(text) >= 80 AS long FROM documents""")
def word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(t).alias("words"), text.space_words(t).alias("spaced"), text.sentence_count(t).alias("sentences"), text.token_estimate(t).alias("tokens"), (F.length(t) >= 80).alias("long"))


@query("SELECT doc_id, greatest(1, ceil(length(text) / 4))::BIGINT AS tokens FROM documents WHERE text <> ''")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text != ''").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query(r"""SELECT doc_id, CASE WHEN ceil(length(text) / 4) <= 100 THEN text
  WHEN length(regexp_replace(left(text, 400), '[ ,;:\n]+$', '')) < length(text) THEN regexp_replace(left(text, 400), '[ ,;:\n]+$', '') || '...' ELSE text END AS cut FROM documents""")
def truncate_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_to_tokens(F.col("text"), 100).alias("cut"))


@query(rf"""WITH n AS (SELECT doc_id, {sql_normalize('text')} AS t FROM documents),
m AS (SELECT doc_id, length(t) AS chars, {sql_words('t')} AS words, len(regexp_extract_all(t, '[\x{{4e00}}-\x{{9fff}}]')) AS cjk FROM n)
SELECT doc_id, chars::BIGINT AS chars, words, chars >= 300 AND CASE WHEN cjk >= 120 AND cjk / chars >= 0.2 THEN cjk >= 180 ELSE words >= 90 END AS enough FROM m""")
def body_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.normalize_text(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.length("t").cast("long").alias("chars"), text.word_count(F.col("t")).alias("words"), text.cjk_count(F.col("t")).alias("cjk"))
    one, none, no = F.lit(1), F.lit(0), F.lit(False)
    return rows.select("doc_id", "chars", "words", verdicts.sufficient_body(F.col("chars"), F.col("words"), one, none, F.col("cjk"), no, F.lit(0.0)).alias("enough"))


#: Licence phrases that the documents hold (fixed values).
LICENCE = ("license", "licence", "all rights reserved", "copyright")


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split({sql_normalize('text')}, chr(10))) AS line FROM documents),
c AS (SELECT doc_id, {sql_words('line')} AS w, regexp_matches(lower(line), 'license|licence|all rights reserved|copyright') AS lic FROM l),
s AS (SELECT doc_id, sum(w)::BIGINT AS words, coalesce(sum(w) FILTER (lic), 0)::BIGINT AS licence_words FROM c GROUP BY doc_id),
v AS (SELECT *, licence_words > 0 AND (words < 250 OR licence_words >= greatest(20, floor(words * 0.6))) AS licence_only FROM s)
SELECT doc_id, words, licence_words, licence_only, words >= 250 AND NOT licence_only AS usable FROM v""")
def license_line_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Lines stay within their row: no explode, no shuffle.
    lines = F.split(text.normalize_text(F.col("text")), "\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    total = lambda keep: F.aggregate(F.filter("lines", keep), F.lit(0).cast("long"), lambda a, x: a + text.word_count(x))
    rows = rows.select("doc_id", total(lambda x: F.lit(True)).alias("words"), total(lambda x: text.contains_any(F.lower(x), LICENCE)).alias("licence_words"))
    only = (F.col("licence_words") > 0) & ((F.col("words") < 250) | (F.col("licence_words") >= F.greatest(F.lit(20), F.floor(F.col("words") * 0.6))))
    return rows.withColumn("licence_only", only).withColumn("usable", (F.col("words") >= 250) & ~F.col("licence_only"))


@query(rf"""WITH k AS (SELECT doc_id, regexp_replace(lower({sql_normalize('text')}), '[^\p{{L}}\p{{N}}]+', '', 'g') AS key FROM documents)
SELECT min(doc_id) AS first_id, count(*)::BIGINT AS copies, md5(key) AS key FROM k GROUP BY key HAVING count(*) > 1""")
def canonical_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only a hash of the key is shuffled.
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(text.match_key(F.col("text")).cast("binary")).alias("key"))
    return rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("first_id", "copies", "key")


@query(rf"""WITH k AS (SELECT min(doc_id) AS doc_id, lang, t FROM (SELECT doc_id, lang, {sql_normalize('text')} AS t FROM documents) GROUP BY lang, t),
p AS (SELECT doc_id, lang, length(t) AS n, left(t, 200) AS head FROM k WHERE length(t) >= 200)
SELECT a.doc_id AS left_id, b.doc_id AS right_id FROM p a JOIN p b ON a.lang = b.lang AND a.head = b.head AND a.doc_id < b.doc_id AND abs(a.n - b.n) <= 64""")
def near_duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.candidate_pairs(similarity.text_classes(table(spark, sf_dir, "documents")))


@query()
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.near_pairs(table(spark, sf_dir, "documents"))


@query(rf"""WITH b AS (SELECT item_id, lower({sql_collapse(sql_normalize('text'))}) AS chunk FROM benchmark),
d AS (SELECT doc_id, lower({sql_collapse(sql_normalize('text'))}) AS body FROM documents),
m AS (SELECT doc_id, count(*)::BIGINT AS matched, max(length(chunk))::BIGINT AS longest FROM d JOIN b ON length(chunk) >= 160 AND contains(body, chunk) GROUP BY doc_id)
SELECT doc_id, matched, longest, longest >= 240 OR matched >= 2 AS overlaps FROM m""")
def overlap_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.passage_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
x AS (SELECT doc_id, w, array_to_string(w, ' ') AS t FROM d WHERE len(w) > 0), y AS (SELECT item_id, w, array_to_string(w, ' ') AS t FROM b WHERE len(w) > 0)
SELECT doc_id, item_id FROM x, y WHERE contains(x.t, y.t) OR contains(y.t, x.t) OR (least(len(x.w), len(y.w)) >= 12
AND x.w[1:least(24, greatest(12, least(len(x.w), len(y.w)) // 3))] = y.w[1:least(24, greatest(12, least(len(x.w), len(y.w)) // 3))])""")
def semantic_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.semantic_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(source || '/' || lang || '  ' || doc_id || '.md', '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g') AS name, substr(sha1(text), 1, 8) AS digest FROM documents""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.concat("source", F.lit("/"), "lang", F.lit("  "), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", text.safe_filename(named).alias("name"), F.left(F.sha1(F.col("text").cast("binary")), F.lit(8)).alias("digest"))


@query(r"""SELECT doc_id, lower(regexp_extract(text, '(10\.[0-9]{4,9}/[^\s"''<>]+)', 1)) AS raw_doi, len(regexp_extract_all(text, '\b(?:19|20)[0-9]{2}\b'))::BIGINT AS years FROM documents""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.regexp_extract(t, ids.DOI, 1)).alias("raw_doi"), F.size(F.regexp_extract_all(t, F.lit(r"\b((?:19|20)[0-9]{2})\b"))).cast("long").alias("years"))


@query(rf"""WITH f AS (SELECT doc_id, l.quality, {sql_words('text')} AS words, d.text <> '' AS body FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN words >= 60 THEN 'fulltext' WHEN words > 0 THEN 'abstract_only' ELSE 'metadata_only' END AS kind,
CASE WHEN words < 60 THEN 'low' WHEN quality IS NULL THEN 'medium' WHEN quality = 0 THEN 'low' ELSE 'high' END AS confidence FROM f""")
def content_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))
    rows = rows.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    kind, no = verdicts.content_kind(F.col("words") >= 60, F.col("words") > 0), F.lit(False)
    sure = verdicts.confidence(kind, F.coalesce(F.col("quality") == 0, no), no, no, F.col("quality").isNull(), F.lit(0))
    return rows.select("doc_id", kind.alias("kind"), sure.alias("confidence"))
