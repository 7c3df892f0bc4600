"""Operators on small literal tables, and independence of how rows are dealt out."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import merge, ordered, references, reports, retention, routing, sections
from lectern.sources import tables as sources


def got(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("parts", [1, 8])
def test_budget(spark, parts):
    df = spark.createDataFrame([(1, 0, "a" * 40), (1, 1, "b" * 600), (1, 2, "c")], "k int, pos int, t string").repartition(parts, F.rand(3))
    kept = ordered.keep_in_budget(df, ["k"], ["pos"], "t", 100)
    assert [(r.pos, r.truncated, len(r.t)) for r in kept.orderBy("pos").collect()] == [(0, False, 40), (1, True, 363)]
    assert got(ordered.keep_in_budget(df, ["k"], ["pos"], "t", 60), "pos") == [(0,)]


def test_runs_and_prefixes(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate("bbxbbbx")], "k int, pos int, s string")
    assert got(ordered.longest_run(df, ["k"], ["pos"], F.col("s") == "b", F.lit(2)), "run_rows", "run_size") == [(3, 6)]
    assert got(ordered.before_first(df, ["k"], ["pos"], F.col("s") == "x"), "pos") == [(0,), (1,), (2,)]
    assert got(ordered.after_first(df, ["k"], ["pos"], F.col("s") == "x"), "pos") == [(0,), (1,)]


def test_merges(spark):
    a = spark.createDataFrame([(1, " ", "x"), (2, None, None)], "k int, f string, g string")
    b = spark.createDataFrame([(1, "B", "y"), (3, "C", None)], "k int, f string, g string")
    assert got(merge.merge_pair(a, b, "k", ["f", "g"]), "k", "f", "g") == [(1, None, "x"), (2, None, None), (3, "C", None)]
    layers = spark.createDataFrame([(1, 0, "", "a", ["X"]), (1, 1, "t", "b", ["x", "Y"])], "k int, ord int, f string, o string, l array<string>")
    row = merge.merge_layers(layers, "k", "ord", fill=["f"], overwrite=["o"], concat=["l"]).first()
    assert (row.f, row.o, row.l) == ("t", "b", ["X", "Y"])
    rows = spark.createDataFrame([(1, "u", 0, None), (1, "u", 1, "n"), (1, "", 2, "a"), (1, "", 3, "b")], "k int, id string, pos int, name string")
    assert got(merge.merge_by_identity(rows, ["k"], "id", "pos", ["name"]), "id", "pos", "name") == [("", 2, "a"), ("", 3, "b"), ("u", 0, "n")]
    assert got(merge.upsert(a, b, "k"), "k", "f") == [(1, "B"), (2, None), (3, "C")]
    assert got(merge.unresolved_failures(a.select("k"), b.select("k"), a.select("k").where("k = 9"), "k"), "k") == [(2,)]


def test_retention_bounds(spark):
    e = spark.createDataFrame([("a", 100, 5), ("b", 90, 5), ("c", 80, 5), ("d", 70, 5)], "p string, t long, b long")
    now = F.lit(100)
    assert got(retention.prune(e, "t", "b", ["p"], now, max_age=20), "p") == [("a",), ("b",), ("c",)]
    assert got(retention.prune(e, "t", "b", ["p"], now, max_entries=2), "p") == [("a",), ("b",)]
    assert got(retention.prune(e, "t", "b", ["p"], now, max_bytes=14), "p") == [("a",), ("b",)]


def test_routing(spark):
    cat = routing.catalog(spark)
    rules = cat.select("provider", "rank", F.explode("domains").alias("domain"))
    pages = spark.createDataFrame([(1, "https://pubs.acs.org/x"), (2, "https://notacs.org/x"), (3, None)], "id int, url string")
    assert got(routing.by_domain(pages, "url", "id", rules), "id", "provider") == [(1, "acs"), (2, None), (3, None)]
    prefixes = cat.select("provider", "rank", F.explode("prefixes").alias("prefix"))
    dois = spark.createDataFrame([("doi:10.1021/abc",), ("10.9/x",)], "doi string")
    assert got(routing.by_doi(dois, "doi", prefixes), "doi_provider") == [("acs",), (None,)]
    names = cat.select("provider", F.explode("names").alias("name"))
    assert got(routing.by_publisher(spark.createDataFrame([("Elsevier BV",)], "p string"), "p", names), "publisher_provider") == [("elsevier",)]


def test_reports(spark):
    f = spark.createDataFrame([(1, "limit", "m1", 0), (1, "fatal", "m2", 1)], "k int, code string, msg string, pos int")
    assert got(reports.worst_failure(f, "k", "code", {"fatal": 0, "limit": 1}, "msg", "pos"), "code", "messages") == [("fatal", "m1; m2")]
    assert reports.exit_code(f, "code", [("fatal", 3), ("limit", 2)]).first().exit_code == 3
    assert reports.exit_code(f.where("k = 9"), "code", [("fatal", 3)]).first().exit_code == 0


def test_sections(spark):
    d = spark.createDataFrame([(1, "intro\n# Abstract\nA\n## Methods\n\n### Site\nS\n## References\nR")], "k int, md string")
    rows = sections.from_markdown(d, "k", "md")
    assert got(rows, "heading", "level", "kind", "text") == [("Abstract", 1, "abstract", "A"), ("Full Text", 2, "body", "intro"), ("References", 2, "references", "R"), ("Site", 3, "body", "S")]
    assert sections.render_in_budget(rows, "k", 1).first().markdown == "## Abstract\n\nA".replace("\n\n", "\n")


def test_references(spark):
    b = spark.createDataFrame([(1, 0, "[1] Doe 1999. 10.1234/ab."), (1, 1, "[1] Doe 1999. 10.1234/ab.")], "k int, pos int, text string")
    assert got(references.reference_rows(b, "k"), "pos", "label", "doi", "year") == [(0, "1", "10.1234/ab", "1999")]


def test_sources(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# c\n\n 10.1/x \nb\n")
    assert got(sources.read_queries(spark, str(tmp_path / "q.txt")), "query") == [("10.1/x",), ("b",)]
    m = spark.createDataFrame([('{"DOI":"10.1/X","title":["T"],"author":[{"given":"A","family":"B"}],"issued":{"date-parts":[[2024,3,1]]},"license":[{"URL":"https://creativecommons.org/x"}]}',)], "j string")
    r = sources.crossref_record(m, "j").first()
    assert (r.doi, r.title, r.authors, r.published, r.open_access) == ("10.1/x", "T", ["A B"], "2024-3-1", True)
    out = spark.createDataFrame([("fulltext", "a"), ("metadata_only", "b")], "content_kind string, markdown string")
    sources.write_markdown(out, str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).where("value != ''").count() == 1
