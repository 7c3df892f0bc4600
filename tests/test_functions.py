"""Literal cases for scalars and row functions."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import ids, text, verdicts
from lectern.operators import html, markup, similarity, tables


def one(spark, make, *values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", list: "array<string>", type(None): "string", bytes: "binary"}
    schema = ", ".join(f"c{i} {kinds[type(v)]}" for i, v in enumerate(values))
    return spark.createDataFrame([tuple(values)], schema).select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "args", "want"),
    [
        (text.normalize_text, (" a  b \n\n  c\t",), "a b\nc"),
        (text.normalize_text, (None,), ""),
        (text.strip_html_tags, ("<p>a<b>b</b></p>\n c",), "a b c"),
        (text.match_key, ("Été, No. 1_x",), "éténo1x"),
        (text.heading_key, ("Results: ",), "results"),
        (text.title_key, ("A&B -- c",), "a b c"),
        (text.journal_key, ("Food & Function.",), "food and function"),
        (text.author_key, ("Doe, Ann",), "ann doe"),
        (text.abstract_text, ("**Abstract.** We show",), "We show"),
        (text.word_count, ("êeux fo_o 12",), 3),
        (text.sentence_count, ("A. B? c",), 2),
        (text.token_estimate, ("abcde",), 2),
        (text.token_estimate, ("",), 0),
        (text.safe_filename, ("a b//c",), "a_b_c"),
        (text.display_name, ("royal_society-x",), "Royal Society X"),
        (ids.clean_doi, ("https://doi.org/10.1/A–b).",), "10.1/a-b"),
        (ids.extract_doi, ("see 10.1234/xY.",), "10.1234/xy"),
        (ids.extract_doi, ("none",), None),
        (ids.arxiv_id, ("https://arxiv.org/abs/2101.00001v2",), "2101.00001"),
        (ids.host, ("HTTPS://u@WWW.X.org:80/p",), "www.x.org"),
        (ids.is_http_url, ("ftp://x",), False),
        (ids.is_api_url, ("https://api.x.org/y",), True),
        (ids.largest_in_srcset, ("a.png 1x, b.png 2x, c.png 900w",), "b.png"),
        (ids.last_year, ("1999 and 2004a 2003",), "2003"),
        (ids.citation_numbers, ("1, 3-5",), "1, 3–5"),
        (ids.citation_numbers, ("1, x",), None),
        (ids.redact_url, ("http://x?a=1&token=abc",), "http://x?a=1&token=***"),
        (verdicts.section_kind, ("Data availability statement",), "data_availability"),
        (verdicts.section_kind, ("Acknowledgements",), "references"),
        (verdicts.section_priority, ("Materials and Methods",), 2),
        (verdicts.section_priority, ("Zebra",), 4),
        (verdicts.preview_acceptable, (600, 120), True),
        (verdicts.preview_acceptable, (299, 200), False),
    ],
)
def test_scalars(spark, f, args, want):
    assert one(spark, f, *args) == want


def test_decode(spark):
    assert one(spark, ids.decode_html, "é".encode()) == "é"
    assert one(spark, ids.decode_html, "é".encode("latin-1")) == "é"


def test_truncation_never_exceeds(spark):
    assert one(spark, lambda c: text.truncate_to_tokens(c, 10), "word " * 30) == ("word " * 8).strip() + "..."
    assert one(spark, lambda c: text.truncate_to_tokens(c, 10), "short") == "short"


def test_signals_are_ordered(spark):
    got = one(spark, lambda a, b: verdicts.access_signals(a, b, F.lit(404)), "Just a moment", "purchase access")
    assert got == ["cloudflare_challenge", "publisher_not_found", "publisher_paywall"]


def test_sufficient_body(spark):
    yes, no = F.lit(True), F.lit(False)
    call = lambda chars, words, blocks, cjk: verdicts.sufficient_body(F.lit(chars), F.lit(words), F.lit(blocks), F.lit(0), F.lit(cjk), no, F.lit(0.0))
    row = spark.range(1).select(call(299, 500, 5, 0), call(400, 60, 2, 0), call(400, 80, 1, 0), call(400, 90, 1, 0), call(500, 3, 1, 180), call(500, 3, 1, 170)).first()
    assert list(row) == [False, True, False, True, True, False]
    assert spark.range(1).select(verdicts.confidence(F.lit("abstract_only"), no, no, no, no, F.lit(0)), verdicts.confidence(F.lit("fulltext"), no, no, no, yes, F.lit(0))).first()[:] == ("low", "medium")


def test_indel_and_matcher():
    assert similarity.indel("abcd", "abed") == pytest.approx(0.75)
    assert similarity.indel("", "") == 1.0
    assert similarity.indel("a", "") == 0.0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_indel_against_table():
    import random

    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, 90))) for _ in range(2))
        assert similarity.indel(a, b) == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)))


def test_html_recovery():
    rows = html.parse_blocks('<html><body><nav><a href="/x">x</a></nav><article><h1>T&amp;u</h1><p>a <b>b<p>c<script>var t="</p>"</script><br>d</article></body>')
    assert [(r["kind"], r["text"], r["chrome"]) for r in rows] == [("link", "x", True), ("heading", "T&u", False), ("paragraph", "a b", False), ("paragraph", "c d", False)]
    assert html.parse_blocks(None) == [] and html.parse_blocks("") == []


def test_table_placement():
    assert tables.place([(0, 2, 1), (0, 1, 2), (1, 1, 1), (1, 1, 1)]) == [(0, 0), (0, 1), (1, 1), (1, 2)]
    assert tables.place([(0, 1, 3), (1, 1, 2)]) is None


def test_images():
    assert markup.image_info(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (5).to_bytes(4, "big") + (7).to_bytes(4, "big")) == {"mime": "image/png", "width": 5, "height": 7}
    assert markup.image_info(b"GIF89a" + b"\x02\x00\x03\x00") == {"mime": "image/gif", "width": 2, "height": 3}
    assert markup.image_info(None) is None


def test_markdown():
    assert markup.strip_images("a ![x [y]](u(1).png \"t\") b") == "a  b"
    assert markup.markdown_images("![a](b c") == []
    assert markup.citations_to_sup("as [1, 3-5] or [2](x)") == "as <sup>1, 3–5</sup> or [2](x)"
    assert markup.normalize_markdown("a  b\n\n\n\n```\n x  y\n```\n| a  | b |") == "a b\n\n```\n x  y\n```\n| a  | b |"
    once = markup.normalize_markdown("x \n\n\n y")
    assert markup.normalize_markdown(once) == once


def test_xml_is_guarded():
    assert markup.jats("<!DOCTYPE a [<!ENTITY x 'y'>]><a>&x;</a>") is None
    assert markup.jats("not xml") is None
    assert markup.mathml_to_latex("<math><mover><mi>x</mi><mo>^</mo></mover></math>") == r"\hat{x}"
