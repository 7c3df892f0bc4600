"""The registered queries ``opN_<name>`` and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import saved
from lectern.llm.decontaminate import find_contamination
from lectern.llm.exact_dedup import progressive_exact_dedup
from lectern.llm.near_dedup import near_duplicates
from lectern.llm.packing import pack_by_length
from lectern.llm.quality import score_quality, train_quality
from lectern.llm.secrets import scan_secrets
from lectern.llm.substring_dedup import remove_repeated_passages
from lectern.llm.token_count import count_tokens
from lectern.llm.toxicity import score_toxicity, train_toxicity
from lectern.llm.wavelet import read_token_shards, write_token_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_exact_dedup(table(spark, sf_dir, "documents"), hash_all=True)


ORACLES["op2_exact_dedup"] = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g ON d.h = g.h
"""


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_shards(write_token_shards(table(spark, sf_dir, "documents"), byte_bpe()))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


@query
def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), byte_bpe())


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeated_passages(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op3_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS a FROM d WHERE len(ws) >= 20),
w AS (SELECT doc_id, a, row_number() OVER (PARTITION BY array_to_string(ws[a:a + 19], ' ') ORDER BY doc_id, a) AS n FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, a + 20)) AS i FROM w WHERE n > 1),
every AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS t FROM every e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id),
lost AS (SELECT doc_id, count(*)::BIGINT AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(l.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN lost l ON d.doc_id = l.doc_id
"""


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, "contaminated")


ORACLES["op7_decontaminate"] = r"""
WITH lower AS (SELECT 'd' AS k, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT k, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lower),
probe AS (SELECT id, unnest([array_to_string(ws[a:a + least(13, len(ws)) - 1], ' ') for a in range(1, greatest(1, len(ws) - 12) + 1)]) AS g, least(13, len(ws)) AS m FROM w WHERE k = 'b' AND len(ws) > 0),
sizes AS (SELECT DISTINCT m FROM probe),
spot AS (SELECT w.id, w.ws, s.m, unnest(range(1, len(w.ws) - s.m + 2)) AS a FROM w, sizes s WHERE w.k = 'd' AND len(w.ws) >= s.m),
found AS (SELECT s.id, s.a, s.m, p.id AS item FROM spot s JOIN (SELECT DISTINCT id, g, m FROM probe) p ON s.m = p.m AND array_to_string(s.ws[s.a:s.a + s.m - 1], ' ') = p.g),
hit AS (SELECT id, count(DISTINCT i)::BIGINT AS n FROM (SELECT id, unnest(range(a, a + m)) AS i FROM found) GROUP BY id),
item AS (SELECT id, count(*)::BIGINT AS n, string_agg(item::VARCHAR, ',' ORDER BY item::VARCHAR) AS l FROM (SELECT DISTINCT id, item FROM found) GROUP BY id)
SELECT w.id AS doc_id, len(w.ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(item.n, 0)::BIGINT AS n_items,
  sha256(coalesce(item.l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w.ws) AS contaminated
FROM w LEFT JOIN hit ON w.id = hit.id LEFT JOIN item ON w.id = item.id WHERE w.k = 'd'
"""


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_by_length(saved(count_tokens(table(spark, sf_dir, "documents"), byte_bpe()), "lengths"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


@query
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op5_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest([array_to_string(ws[a:a + 4], ' ') for a in range(1, greatest(1, len(ws) - 4) + 1)]) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
