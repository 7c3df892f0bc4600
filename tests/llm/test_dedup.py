"""Exact, substring and near deduplication against brute force."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.llm.exact_dedup import progressive_exact_dedup
from lectern.llm.near_dedup import near_duplicates
from lectern.llm.substring_dedup import remove_repeated_passages


def test_exact(docs, nasty, empty):
    groups = defaultdict(list)
    for r in nasty:
        groups[r[1] or ""].append(r[0])
    got = progressive_exact_dedup(docs, hash_all=True).collect()
    assert len(got) == len(nasty)
    want = sorted((str(i), hashlib.sha256(t.encode()).hexdigest(), len(g), max((x for x in g if x is not None), default=None)) for t, g in groups.items() for i in g)
    assert sorted((str(r.doc_id), r.text_sha256, r.group_size, r.keep_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    lazy = {r.doc_id: r.text_sha256 for r in progressive_exact_dedup(docs).collect()}
    assert lazy[len(nasty) - 5] is None or len(lazy[len(nasty) - 5]) == 64
    assert progressive_exact_dedup(empty).count() == 0


def brute_passages(rows, window):
    first, out = {}, {}
    rows = sorted(rows, key=lambda r: r[0])
    split = {r[0]: (r[1] or "").encode().split() for r in rows}
    for i, words in split.items():
        gone = set()
        for a in range(len(words) - window + 1):
            w = tuple(words[a : a + window])
            if first.setdefault(w, (i, a)) != (i, a):
                gone.update(range(a, a + window))
        out[i] = (len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode())
    return out


@pytest.mark.parametrize("window", [20, 3])
def test_substring(unique, window):
    rows = [(r.doc_id, r.text) for r in unique.collect()]
    want = brute_passages(rows, window)
    got = remove_repeated_passages(unique, window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == want
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_substring_edges(docs, nasty, empty):
    got = remove_repeated_passages(docs).collect()
    assert len(got) == len(nasty)
    # A null id is the smallest: its copy of the base text stays whole; rows that share an id do not remove each other's words.
    assert sorted(r.n_removed for r in got if r.doc_id is None) == [0, 0]
    assert len({(r.n_removed, r.kept_text) for r in got if r.doc_id == 4}) == 1
    assert remove_repeated_passages(empty).count() == 0


def shingles(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("tile", [2048, 2])
def test_near(spark, unique, tile):
    import random

    r = random.Random(2)
    rows = [(x.doc_id, x.text) for x in unique.collect()]
    base = [f"v{i}" for i in range(80)]
    for k in range(40):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(80)] = f"n{r.randrange(1000)}"
        rows.append((100 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_duplicates(df, tile_docs=tile).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_near(rows)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_near_edges(docs, nasty, empty):
    got = near_duplicates(docs).collect()
    assert len(got) == len(nasty)
    assert {r.component_id for r in got if r.doc_id == 8} == {None}  # linked with the row without id, which counts as smallest
    assert near_duplicates(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 103), (103, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, 103: 100}
    assert components(edges.where(F.lit(False))).count() == 0
