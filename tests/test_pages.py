"""Page queries against their SQL on a page whose title and heading are cut inside a character reference."""

import pandas as pd
import pytest

from lectern.operators.html import parse_blocks
from lectern.plans.registry import ORACLES, QUERIES
from oracle import check


@pytest.fixture(scope="module")
def cut_pages(tmp_path_factory):
    page = '<html><head><meta charset="utf-8"><title>{0}</title><style>p{{margin:0}}</style><script>var t;</script></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">ad</div><article><h1>{0}</h1><p><b>{0}</b> and &lt;i&gt;.</p></article></body></html>'
    cuts = ["x&amp;&amp", "x&amp;&am", "x&lt", "&quot y", "&ltx z", "&amp;lt", "whole&amp;"]
    top = tmp_path_factory.mktemp("pages")
    pd.DataFrame({"page_id": range(len(cuts)), "html": [page.format(c) for c in cuts]}).to_parquet(f"{top}/pages.parquet")
    return str(top)


@pytest.mark.parametrize("name", ["html_blocks", "clean_blocks", "container_scores", "page_markdown", "page_metadata"])
def test_cut_references(spark, cut_pages, name):
    check(QUERIES[name](spark, cut_pages), ORACLES[name], cut_pages)


def test_references():
    said = lambda t: parse_blocks(f"<p>{t}</p>")[0]["text"]
    assert [said(t) for t in ("a&amp", "a&ampb;", "&notit;", "&nope;", "&amp;lt;", "&eacute;&#233;&#xe9;", "a & b&")] == ["a&amp", "a&ampb;", "&notit;", "&nope;", "&lt;", "ééé", "a & b&"]
    assert parse_blocks('<a href="?x=1&copy=2&amp;y">t</a>')[0]["href"] == "?x=1&copy=2&y"
