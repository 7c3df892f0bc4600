"""Recall of near-duplicate links about the threshold, and pipeline stages on empty tables."""

import random

import corpus_pipeline
import pyarrow as pa
import pytest
from lectern.llm import near_dedup
from lectern.llm.near_dedup import near_duplicates
from test_dedup import brute_near


def test_links_about_the_threshold_are_found(spark):
    """Pairs whose similarity lies between 0.70 and 0.80, among texts that share a head with all others."""
    r = random.Random(11)
    rows = []
    for k in range(250):
        words = [f"a{k}x{r.randrange(10**6)}" for _ in range(120)]
        other = list(words)
        for i in r.sample(range(5, 115, 6), r.choice([2, 3, 3, 4])):
            other[i] = f"b{r.randrange(10**6)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    want = brute_near(rows)
    linked = {i for i, (_, c) in want.items() if c != i}
    assert 50 < len(linked) < 240
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == want


def test_rows_that_share_an_id_keep_their_links(spark):
    say = lambda seed: " ".join(f"w{random.Random(seed).randrange(10**6) + i}" for i in range(90))
    near = say(1) + " tail"
    rows = [(1, say(1)), (5, near), (5, say(2)), (9, say(3))]
    got = sorted((x.doc_id, x.component_id) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (5, 1), (5, 5), (9, 9)]


@pytest.mark.parametrize("n", [150, 300])
def test_links_of_a_group_do_not_multiply_with_the_orders(spark, monkeypatch, n):
    """All 32 orders find a group of near copies; a few links a member are left of that, and one once confirmed."""
    r = random.Random(3)
    base, rows = [f"v{i}" for i in range(400)], []
    for k in range(n):
        words = list(base)
        for i in r.sample(range(400), 4):
            words[i] = f"n{r.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    asked, real = [], near_dedup.components

    def components(links):
        asked.append({tuple(sorted(x)) for x in links.collect()})
        return real(links)

    monkeypatch.setattr(near_dedup, "components", components)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {(x.doc_id, x.component_id) for x in got} == {(k, 0) for k in range(n)}
    assert n - 1 <= len(asked[0]) < 5 * n
    assert len(asked[1]) == n - 1 and len({a for a, _ in asked[1]}) == 1


def test_stars(monkeypatch):
    """What is held together stays so, across the pieces that a bound on memory makes too; a loop links nothing."""
    links = [(5, 9), (9, 7), (1, 2), (4, 4), (7, 3), (2, -6)]
    out = [(a, b) for x in near_dedup._stars(links) for a, b in zip(*[c.to_pylist() for c in x.columns], strict=True)]
    assert sorted(out) == [(-6, 1), (-6, 2), (3, 5), (3, 7), (3, 9)]
    monkeypatch.setattr(near_dedup, "HELD_ROWS", 2)
    pieces = list(near_dedup._stars(links))
    assert len(pieces) == 5 and pa.Table.from_batches(pieces).num_rows == 5
    assert not list(near_dedup._stars([]))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_no_documents(spark, name):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, _row string")
    assert dict(corpus_pipeline.STAGES)[name](spark, empty, "/root/testdata/sf0.001").count() == 0
