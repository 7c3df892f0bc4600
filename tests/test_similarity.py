"""Similarity operators against brute force on small literal tables."""

import random

from lectern.operators import similarity


def brute_semantic(a, b):
    a, b = similarity.semantic_key(a), similarity.semantic_key(b)
    if not a or not b:
        return False
    x, y = a.split(), b.split()
    shared = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    return a in b or b in a or shared >= min(24, max(12, min(len(x), len(y)) // 3))


def test_semantic_matches(spark, monkeypatch):
    r = random.Random(3)
    say = lambda n: " ".join(r.choice("abcdefgh") + r.choice(["", "é", "1"]) for _ in range(n))
    long, other = say(90), say(90)
    head = lambda n: " ".join(long.split()[:n] + other.split()[n:])
    texts = [None, "", "--", "a", "A, b", long, long.upper(), head(12), head(23), head(24), head(30), "x" + long + "y", say(3) + " " + long + "! " + say(4), " ".join(long.split()[10:25]), " ".join(long.split()[:12]) + " z", say(40), *(say(n) for n in range(1, 30))]
    rows = list(enumerate(texts))
    want = {(i, j) for i, a in rows for j, b in rows if brute_semantic(a, b)}
    docs, items = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(rows, "item_id long, text string")
    assert (5, 6) in want and (12, 5) in want and (7, 5) not in want
    for size in (similarity.PHRASE_BYTES, 600):
        monkeypatch.setattr(similarity, "PHRASE_BYTES", size)
        assert sorted(map(tuple, similarity.semantic_matches(docs, items).collect())) == sorted(want)


def test_titles(spark, monkeypatch):
    r = random.Random(5)
    texts = ["the same title"] * 60 + [" ".join(r.choice(["the", "of", "and", "x", "y", "z", *map(str, range(9))]) for _ in range(r.randint(1, 7))) for _ in range(120)] + ["", None, "alone"]
    r.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    sets = {i: set((t or "").split()) for i, t in rows}
    pairs = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and x & y}
    best = {}
    for (a, b), s in sorted(pairs.items(), key=lambda p: (-round(p[1], 6), p[0][1])):
        best.setdefault(a, []).append((b, round(s, 6)))
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    for size in (similarity.TILE_ROWS, 40):
        monkeypatch.setattr(similarity, "TILE_ROWS", size)
        got = {}
        for x in sorted(similarity.best_titles(df, "id", "t").collect(), key=lambda x: (-x.score, x.right_id)):
            got.setdefault(x.left_id, []).append((x.right_id, x.score))
        assert {a: v[:2] for a, v in got.items()} == {a: v[:2] for a, v in best.items()}
        alike = similarity.alike_titles(df, "id", "t", 0.5).collect()
        assert sorted((x.left_id, x.right_id, x.score, x.ratio) for x in alike) == sorted((a, b, s, similarity.indel(texts[a], texts[b])) for (a, b), s in pairs.items() if s >= 0.5)


def test_near_pairs(spark):
    from difflib import SequenceMatcher

    r = random.Random(7)
    say = lambda n: " ".join(r.choice(["the", "of", "alpha", "beta"]) + str(r.randrange(30)) for _ in range(n))
    texts = [None, "", "", "short", "short"]
    for base in (say(30), say(100), say(500), "nospace" * 40, "".join(r.choice("abc") for _ in range(900))):
        texts += [base, base, base[1:], "x" + base[1:], base[:150] + base[151:], base.replace(" ", "", 1)]
        for _ in range(12):
            t = list(base)
            for _ in range(r.randint(1, 6)):
                t[r.randrange(len(t))] = r.choice(["", " ", "q", "zz"])
            texts.append("".join(t).strip())
    texts = [t and " ".join(t.split()) for t in texts]
    langs = ["en", "de", None]
    rows = [(i, langs[0] if i % 9 else langs[i % 3], t) for i, t in enumerate(texts)]
    first = {}
    for i, lang, t in rows:
        first.setdefault((lang, t or ""), i)
    want = {(first[lang, t], i) for i, lang, t in rows if t and first[lang, t] != i}
    alone = [(i, lang, t) for (lang, t), i in first.items() if t]
    near = {(a, b) for a, la, x in alone for b, lb, y in alone if a < b and la == lb and la and abs(len(x) - len(y)) <= 64 and SequenceMatcher(None, x, y).ratio() >= 0.995}
    assert sum(texts[a][:200] != texts[b][:200] for a, b in near) > 5 and any(len(texts[b]) < 300 for a, b in near)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    got = similarity.near_pairs(docs).collect()
    assert sorted((x.left_id, x.right_id) for x in got) == sorted(want | near)
