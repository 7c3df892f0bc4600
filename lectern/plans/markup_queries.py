"""Queries over parsed pages, tables, XML, formulas, links and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import title_key
from lectern.operators import abstracts, html, markup, merge, publisher_xml, references, scripts, similarity, tables
from lectern.plans.registry import query, table
from lectern.sources.shipping import ship


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return html.html_blocks(table(spark, sf_dir, "pages"))


#: Blocks of the pages for DuckDB: their markup is regular, so that patterns can take it apart.
_SAID = r"trim(regexp_replace(replace(replace(replace(replace(regexp_replace(replace({0}, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"')
_BLOCKS = rf"""WITH h AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS items, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS seg FROM pages),
g AS (SELECT page_id, title, items, 10 + 2 * len(items) AS root, regexp_extract(seg, '<h1>([^<]*)</h1>', 1) AS h1, [string_split(x, '</p>')[1] for x in string_split(seg, '<p>')[2:]] AS ps FROM h),
l AS (SELECT page_id, root, list_concat([{{'kind': 'meta', 'tag': 'meta', 'level': NULL::INT, 'text': '', 'chrome': false, 'root': 0}}, {{'kind': 'title', 'tag': 'title', 'level': NULL::INT, 'text': {_SAID.format("title")}, 'chrome': false, 'root': 0}}],
  flatten([[{{'kind': 'item', 'tag': 'li', 'level': NULL::INT, 'text': {_SAID.format("i")}, 'chrome': true, 'root': 6}}, {{'kind': 'link', 'tag': 'a', 'level': NULL::INT, 'text': {_SAID.format("i")}, 'chrome': true, 'root': 6}}] for i in items]),
  [{{'kind': 'heading', 'tag': 'h1', 'level': 1::INT, 'text': {_SAID.format("h1")}, 'chrome': false, 'root': root::INT}}], [{{'kind': 'paragraph', 'tag': 'p', 'level': NULL::INT, 'text': {_SAID.format("p")}, 'chrome': false, 'root': root::INT}} for p in ps]) AS every FROM g),
m AS (SELECT page_id, root, list_filter(every, lambda x: x.text <> '' OR x.kind = 'meta') AS every FROM l),
b AS (SELECT page_id, unnest(range(len(every)))::INT AS pos, unnest(every) AS e FROM m), r AS (SELECT page_id, pos, e.kind, e.tag, e.level, e.text, e.chrome, e.root FROM b)"""
_WORDS = "len(list_filter(string_split(text, ' '), lambda x: x <> ''))"


@query(_BLOCKS + " SELECT page_id, pos, kind, tag, level, text, chrome FROM r")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("page_id", "pos", "kind", "tag", "level", "text", "chrome")


@query(_BLOCKS + f" SELECT page_id, root, sum({_WORDS})::BIGINT AS words FROM r WHERE NOT chrome AND kind IN ('heading', 'paragraph') GROUP BY page_id, root")
def content_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.content_root(_blocks(spark, sf_dir))


@query(_BLOCKS + " SELECT page_id, pos, kind, tag, level, text, CASE WHEN kind = 'heading' THEN 'front_matter' ELSE 'body' END AS category FROM r WHERE NOT chrome AND kind IN ('heading', 'paragraph', 'item')")
def clean_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.clean_blocks(_blocks(spark, sf_dir))


@query(_BLOCKS + " SELECT page_id, coalesce(min(text) FILTER (kind = 'heading'), min(text) FILTER (kind = 'title')) AS title, NULL::VARCHAR AS abstract, NULL::VARCHAR AS journal_title, NULL::VARCHAR AS doi, NULL::VARCHAR AS published, '' AS authors FROM r GROUP BY page_id")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.metadata(_blocks(spark, sf_dir)).withColumn("authors", F.array_join("authors", "|"))


@query(
    """SELECT p_partkey AS page_id, 'T ' || p_name AS title, 'About ' || p_type AS abstract, CASE WHEN p_size % 2 = 0 THEN p_brand END AS journal_title, '10.1/p' || p_partkey AS doi, '20' || p_size AS published,
array_to_string(list_sort(list_distinct([p_brand, 'Ann'])), '|') AS authors FROM part"""
)
def article_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta elements in mixed case and order; the first of several counts, and a page without ``h1`` has the title of its meta element."""
    ship(spark)
    journal = F.when(F.col("p_size") % 2 == 0, F.format_string('<META NAME="citation_journal_title" CONTENT="%s">', F.col("p_brand"))).otherwise("")
    page = F.format_string(
        '<html><head><title>x</title><meta name="citation_title" content="T %s"><meta name="Description" content="About %s">%s<meta name="citation_doi" content="10.1/p%s"><meta name="citation_doi" content="10.1/q"><meta name="citation_publication_date" content="20%s"><meta name="citation_author" content="%s"><meta name="citation_author" content="Ann"></head><body><p>y</p></body></html>',
        F.col("p_name"), F.col("p_type"), journal, F.col("p_partkey"), F.col("p_size"), F.col("p_brand"),
    )
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), page.alias("html"))
    return html.metadata(html.html_blocks(pages)).withColumn("authors", F.array_join("authors", "|"))


@query(_BLOCKS + " SELECT page_id, string_agg(CASE WHEN kind = 'heading' THEN '# ' || text ELSE text END, chr(10) || chr(10) ORDER BY pos) AS markdown FROM r WHERE NOT chrome AND kind IN ('heading', 'paragraph', 'item') GROUP BY page_id")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.to_markdown(_blocks(spark, sf_dir))


@query(_BLOCKS + " SELECT page_id, root, sum(length(text) + CASE kind WHEN 'heading' THEN 200 WHEN 'paragraph' THEN 40 WHEN 'image' THEN 20 ELSE 0 END)::BIGINT AS score FROM r WHERE NOT chrome GROUP BY page_id, root")
def container_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.container_scores(_blocks(spark, sf_dir))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each part: a head of two rows with spans, and a row of values."""
    ship(spark)
    cell = lambda row, at, text, head, down, across: F.struct(F.lit(row).alias("row"), F.lit(at).alias("cell"), text.cast("string").alias("text"), F.lit(head).alias("is_header"), F.lit(down).alias("rowspan"), F.lit(across).alias("colspan"))
    cells = [
        cell(0, 0, F.col("p_type"), True, 2, 1), cell(0, 1, F.col("p_brand"), True, 1, 2), cell(1, 0, F.lit("size"), True, 1, 1), cell(1, 1, F.col("p_brand"), True, 1, 1),
        cell(2, 0, F.col("p_partkey"), False, 1, 1), cell(2, 1, F.col("p_size"), False, 1, 1), cell(2, 2, F.concat(F.col("p_name"), F.lit("|x")), False, 1, 1),
    ]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("table_id"), F.explode(F.array(*cells)).alias("c")).select("table_id", "c.*")


@query("""SELECT p_partkey::BIGINT AS table_id, unnest([0, 0, 0, 1, 1, 1, 2, 2, 2])::INT AS "row", unnest([0, 1, 2, 0, 1, 2, 0, 1, 2])::INT AS col,
unnest([p_type, p_brand, p_brand, p_type, 'size', p_brand, p_partkey::VARCHAR, p_size::VARCHAR, p_name || '|x']) AS text FROM part""")
def span_expand_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.expand(_cells(spark, sf_dir)).select("table_id", "row", "col", "text")


@query(r"""WITH t AS (SELECT p_partkey::BIGINT AS table_id, [p_type, p_brand || ' / size', p_brand] AS h, [p_partkey::VARCHAR, p_size::VARCHAR, p_name || '\|x'] AS v FROM part),
w AS (SELECT table_id, h, v, [greatest(3, length(h[i]), length(v[i])) for i in range(1, 4)] AS w FROM t)
SELECT table_id, '| ' || array_to_string([rpad(h[i], w[i]::INT, ' ') for i in range(1, 4)], ' | ') || ' |' || chr(10) || '| ' || array_to_string([repeat('-', w[i]) for i in range(1, 4)], ' | ') || ' |' || chr(10)
|| '| ' || array_to_string([rpad(v[i], w[i]::INT, ' ') for i in range(1, 4)], ' | ') || ' |' AS markdown FROM w""")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.to_markdown(tables.expand(_cells(spark, sf_dir)))


@query(r"""WITH a AS (SELECT page_id AS doc, url || '/a.png' AS url, 'p/' || page_id || '-a.png' AS path FROM pages UNION ALL SELECT page_id, 'http://x/sub/b' || page_id || '.png', 'p/b.png' FROM pages
UNION ALL SELECT page_id, 'http://y/c.png', 'p/c1.png' FROM pages UNION ALL SELECT page_id, 'http://z/c.png', CASE WHEN page_id % 2 = 0 THEN 'p/c2.png' ELSE 'p/c1.png' END FROM pages),
l AS (SELECT page_id AS doc, unnest([url || '/a.png', 'B' || page_id || '.PNG?x=1', 'c.png', 'none.png']) AS url FROM pages),
b AS (SELECT doc, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1)) AS base, min(path) AS path FROM a GROUP BY 1, 2 HAVING count(DISTINCT path) = 1),
e AS (SELECT doc, url, min(path) AS path FROM a GROUP BY 1, 2)
SELECT l.doc, l.url, coalesce(e.path, b.path, l.url) AS path FROM l LEFT JOIN e ON l.doc = e.doc AND l.url = e.url LEFT JOIN b ON l.doc = b.doc AND b.base <> '' AND lower(regexp_extract(regexp_replace(l.url, '[?#].*$', ''), '([^/]*)$', 1)) = b.base""")
def link_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four links a page, the last without an asset, to assets some of which share a file name."""
    pages = table(spark, sf_dir, "pages")
    n = F.col("page_id").cast("string")
    asset = lambda url, path: F.struct(url.alias("url"), path.alias("path"))
    third = F.when(F.col("page_id") % 2 == 0, "p/c2.png").otherwise("p/c1.png")
    held = [asset(F.concat("url", F.lit("/a.png")), F.concat(F.lit("p/"), n, F.lit("-a.png"))), asset(F.concat(F.lit("http://x/sub/b"), n, F.lit(".png")), F.lit("p/b.png")), asset(F.lit("http://y/c.png"), F.lit("p/c1.png")), asset(F.lit("http://z/c.png"), third)]
    assets = pages.select(F.col("page_id").alias("doc"), F.explode(F.array(*held)).alias("a")).select("doc", "a.*")
    links = pages.select(F.col("page_id").alias("doc"), F.explode(F.array(F.concat("url", F.lit("/a.png")), F.concat(F.lit("B"), n, F.lit(".PNG?x=1")), F.lit("c.png"), F.lit("none.png"))).alias("url"))
    return references.rewrite_links(links, assets, "doc").select("doc", "url", "path")


def _parts(spark: SparkSession, sf_dir: str, pattern: str, *values: str) -> DataFrame:
    """``id, t``: the pattern filled with the columns of each part."""
    ship(spark)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.format_string(pattern, *[F.col(v) for v in values]).alias("t"))


@query(r"""SELECT p_partkey AS id, '\sqrt{\frac{\mathrm{' || p_type || '}}{b^{' || p_size || '}}} + \sum_{i}^{n} \alpha' AS latex FROM part""")
def mathml_to_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = "<math><msqrt><mfrac><mi>%s</mi><msup><mi>b</mi><mn>%s</mn></msup></mfrac></msqrt><mo>+</mo><munderover><mo>∑</mo><mi>i</mi><mi>n</mi></munderover><mi>α</mi></math>"
    return _parts(spark, sf_dir, xml, "p_type", "p_size").select("id", markup.arrow(markup.mathml_to_latex, "string")(F.col("t")).alias("latex"))


@query(r"""SELECT p_partkey AS id, '\frac{' || p_size || '}{' || p_type || '} \le x_' || p_size || ' \ge \ne' AS latex FROM part""")
def latex_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, r"$ \dfrac{ %s }{%s}  \leq  x _ %s \geq \quad \neq $", "p_size", "p_type", "p_size").select("id", markup.arrow(markup.normalize_latex, "string")(F.col("t")).alias("latex"))


ARTICLE = "<article><front><journal-meta><journal-title>%s</journal-title></journal-meta><article-meta><article-id pub-id-type='doi'>10.1234/AB%s</article-id><title-group><article-title>On <italic>%s</italic></article-title></title-group><contrib-group><contrib contrib-type='author'><name><surname>Doe</surname><given-names>%s</given-names></name></contrib></contrib-group><pub-date pub-type='epub'><day>3</day><month>2</month><year>20%s</year></pub-date><abstract><p>Short.</p></abstract></article-meta></front><body><sec><title>Intro</title><p>One <sup>2</sup>.</p><sec><title>Sub</title><p>Two %s.</p></sec></sec></body><back><ref-list><ref id='r1'><label>1</label><mixed-citation>Doe. <year>1999</year><pub-id pub-id-type='doi'>10.1/Z</pub-id></mixed-citation></ref></ref-list></back></article>"


@query(r"""SELECT p_partkey AS id, 'On *' || p_name || '*' AS title, '10.1234/ab' || p_partkey AS doi, '3 2 20' || p_size AS published, p_type || ' Doe' AS authors,
'## Intro' || chr(10) || chr(10) || 'One <sup>2</sup>.' || chr(10) || chr(10) || '### Sub' || chr(10) || chr(10) || 'Two ' || p_name || '.' AS markdown, 1::BIGINT AS n_refs FROM part""")
def jats_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, ARTICLE, "p_brand", "p_partkey", "p_name", "p_type", "p_size", "p_name").withColumn("a", markup.structs(markup.jats, markup.JATS)(F.col("t")))
    return rows.select("id", "a.title", "a.doi", "a.published", F.array_join("a.authors", ",").alias("authors"), "a.markdown", F.size("a.references").cast("long").alias("n_refs"))


_TITLES = r"""t AS (SELECT page_id, regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+', ' ', 'g') AS t FROM pages),
w AS (SELECT DISTINCT page_id, unnest(string_split(t, ' ')) AS w FROM t), v AS (SELECT page_id, w FROM w WHERE w <> ''), n AS (SELECT page_id, count(*) AS n FROM v GROUP BY page_id),
c AS (SELECT DISTINCT a.page_id AS l, b.page_id AS r FROM v a JOIN v b USING (w) WHERE a.page_id < b.page_id),
s AS (SELECT l, r, count(*) AS i FROM c JOIN v a ON a.page_id = l JOIN v b ON b.page_id = r AND a.w = b.w GROUP BY l, r),
j AS (SELECT l, r, round(i / (p.n + q.n - i), 6) AS score FROM s JOIN n p ON p.page_id = l JOIN n q ON q.page_id = r)"""


@query(f"""WITH {_TITLES}, k AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS k, lead(score) OVER (PARTITION BY l ORDER BY score DESC, r) AS second FROM j)
SELECT l AS left_id, r AS right_id, score, score >= 0.9 AND score - coalesce(second, 0) >= 0.05 AS confident FROM k WHERE k = 1""")
def title_match_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = similarity.best_titles(_titles(spark, sf_dir), "page_id", "t")
    w = Window.partitionBy("left_id").orderBy(F.col("score").desc(), "right_id")
    top = scored.withColumn("k", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("k = 1")
    return top.select("left_id", "right_id", "score", similarity.confident(F.col("score"), F.col("second")).alias("confident"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", title_key(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("t"))


@query()
def title_match_blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similarity.alike_titles(_titles(spark, sf_dir), "page_id", "t", 0.5)
    return pairs.select("left_id", "right_id", similarity.blended_score(F.col("score"), F.col("ratio")).alias("score"))


@query("""SELECT doc, label, min(pos)::BIGINT AS pos FROM (SELECT c_custkey AS doc, unnest([c_nationkey::VARCHAR, (c_nationkey + 30)::VARCHAR, 's3', '2b', '2', c_nationkey::VARCHAR]) AS label, unnest([0, 0, 0, 1, 1, 1]) AS pos FROM customer) GROUP BY doc, label""")
def figure_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two paragraphs for each customer."""
    n = F.col("c_nationkey")
    says = F.array(F.format_string("See Figs %s, %s and S3.", n, n + 30), F.format_string("Fig. 2b shows config 7, as Figure %s", n))
    return references.figure_mentions(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.posexplode(says).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long")), "doc")


@query("""WITH f AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS u, min(turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id),
h AS (SELECT *, min(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS first_a FROM conversations)
SELECT h.conv_id, h.turn::BIGINT AS pos, h.role AS name, CASE WHEN h.role = 'user' AND h.turn = f.u AND (f.a IS NULL OR f.u < f.a) THEN 'body' WHEN h.role = 'assistant' AND h.turn = f.a THEN 'abstract' END AS kind
FROM h JOIN f ON h.conv_id = f.conv_id""")
def section_hint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as headings; each conversation hints that a user's turn is body and a later assistant's turn is abstract."""
    ship(spark)
    turns = table(spark, sf_dir, "conversations")
    hint = lambda n, name, kind: F.struct(F.lit(n).alias("ord"), F.lit(name).alias("name"), F.lit(kind).alias("kind"))
    hints = turns.select("conv_id").distinct().select("conv_id", F.explode(F.array(hint(5, "assistant", "abstract"), hint(1, "user", "body"))).alias("h")).select("conv_id", "h.*")
    return references.match_hints(turns.select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("name")), hints, "conv_id")


@query("""SELECT user_id, coalesce(max(value) FILTER (event_type = 'purchase'), max(value) FILTER (event_type = 'view')) AS value FROM events WHERE event_type IN ('purchase', 'view') GROUP BY user_id""")
def retry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    part = lambda t: e.where(F.col("event_type") == t).groupBy("user_id").agg(F.max("value").alias("value"))
    return merge.retry_merge(part("view"), part("purchase"), "user_id", ["value"])


@query("""SELECT doc_id, len(regexp_extract_all(text, '\\[[0-9]+\\]'))::BIGINT AS n FROM documents""")
def citation_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"(\[[0-9]+\])"))).cast("long").alias("n"))


@query("""SELECT p_partkey AS id, '<sup>1, ' || p_size || '–' || (p_size + 2) || '</sup> and [' || p_size || '](x) of ' || p_name || ' <sup>7a</sup>[b]' AS text FROM part""")
def citations_to_sup(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.format_string("[1 ,%s - %s] and [%s](x) of %s [7a][b]", F.col("p_size"), F.col("p_size") + 2, F.col("p_size"), F.col("p_name"))
    ship(spark)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), markup.arrow(markup.citations_to_sup, "string")(said).alias("text"))


PUBLISHER_ARTICLE = '<r xmlns:ce="u"><ce:title>On %s</ce:title><ce:doi>10.1/A%s</ce:doi><ce:author><ce:given-name>Ann</ce:given-name><ce:surname>%s</ce:surname></ce:author><ce:body><ce:sections><ce:section><ce:section-title>Intro</ce:section-title><ce:para>Text <ce:bold>%s</ce:bold>.</ce:para></ce:section></ce:sections></ce:body></r>'


@query("""SELECT p_partkey AS id, 'On ' || p_name AS title, '10.1/a' || p_partkey AS doi, 'Ann ' || p_type AS authors, '## Intro' || chr(10) || chr(10) || 'Text **' || p_size || '**.' AS markdown FROM part""")
def publisher_xml_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, PUBLISHER_ARTICLE, "p_name", "p_partkey", "p_type", "p_size").withColumn("a", markup.structs(publisher_xml.article, publisher_xml.ARTICLE)(F.col("t")))
    return rows.select("id", "a.title", "a.doi", F.array_join("a.authors", ",").alias("authors"), "a.markdown")


CALS = '<t><colspec colname="a"/><colspec colname="b"/><thead><row><entry namest="a" nameend="b">%s</entry></row></thead><tbody><row><entry morerows="1">%s</entry><entry>%s</entry></row><row><entry>%s</entry></row></tbody></t>'


@query("""SELECT p_partkey AS id, unnest([0, 0, 1, 1, 2, 2])::INT AS "row", unnest([0, 1, 0, 1, 0, 1])::INT AS col, unnest([p_type, p_type, p_size::VARCHAR, p_name, p_size::VARCHAR, p_brand]) AS text, false AS lossy FROM part""")
def cals_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, CALS, "p_type", "p_size", "p_name", "p_brand").withColumn("g", markup.structs(publisher_xml.cals_grid, publisher_xml.GRID)(F.col("t")))
    return rows.select("id", F.explode("g.cells").alias("c"), "g.lossy").select("id", "c.row", "c.col", "c.text", "lossy")


@query("""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 2 END::BIGINT AS n_authors,
CASE WHEN page_id % 3 = 0 THEN '' ELSE 'A ' || page_id || ',B' END AS authors FROM pages""")
def page_script_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with linked data put at their end, which in a third of them does not parse."""
    ship(spark)
    end = F.when(F.col("page_id") % 3 == 0, ", ]").otherwise("]")
    data = F.concat(F.lit('<script type="application/ld+json">[{"@type": "Article", "author": [{"name": "A  '), F.col("page_id").cast("string"), F.lit('"}, "B"]}, {"creator": {"name": "B"}}'), end, F.lit("</script>"))
    names = markup.arrow(scripts.linked_authors, "array<string>")
    lang = markup.arrow(publisher_xml.language_hint, "string")(F.regexp_extract("html", '<html lang="([a-z]+)"', 1))
    rows = table(spark, sf_dir, "pages").select("page_id", lang.alias("lang"), names(F.concat("html", data)).alias("a"))
    return rows.select("page_id", "lang", F.size("a").cast("long").alias("n_authors"), F.array_join("a", ",").alias("authors"))


@query("""SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'system' GROUP BY conv_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')""")
def distinct_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = table(spark, sf_dir, "conversations").where("role = 'system'")
    return abstracts.distinct_abstracts(rows, "conv_id", "turn", "text").select("conv_id", "turn")
