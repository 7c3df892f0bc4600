"""The sketches of near pairs are computed once."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from lectern.operators import similarity


def test_one_pass(spark):
    docs = spark.createDataFrame([(1, "en", "one text of a few words"), (2, None, None), (3, "de", " ")], "doc_id long, lang string, text string")
    df = similarity.text_sketches(docs, 0.995)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1
    assert [(r.doc_id, r.lang, r.n, sum(r.bag)) for r in df.collect()] == [(1, "en", 23, 23)]


def test_sketches_and_pairs_are_held_before_they_are_joined(spark):
    spark.catalog.clearCache()
    docs = spark.createDataFrame([(i, "en", "the same few words " * 30 + "x" * (i % 3)) for i in range(9)], "doc_id long, lang string, text string")
    similarity.near_pairs(docs)
    held = spark.sparkContext._jsc.sc().getRDDStorageInfo()
    assert sum(r.numCachedPartitions() == r.numPartitions() for r in held) == 2
    spark.catalog.clearCache()


def made(plan):
    """Most rows that a node of an executed plan gives."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return made(plan.executedPlan())
    inner = [plan.plan()] if plan.getClass().getSimpleName().endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    rows = plan.metrics().get("numOutputRows")
    return max([rows.get().value() if rows.isDefined() else 0, *map(made, inner)])


def test_a_common_passage_does_not_pair_all_texts_that_hold_it(spark):
    r = random.Random(1)
    say = lambda n: " ".join(str(r.randrange(10**6)) for _ in range(n))
    passage = say(150)
    texts = [f"{passage} {say(30)} {passage}" for _ in range(300)]
    texts += [texts[0][:-1] + "x", texts[1] + " y"]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").repartition(3)
    classes = similarity.text_sketches(docs, 0.995).localCheckpoint()
    pairs = similarity.edits_pairs(classes, 0.995)
    assert {(0, 300), (1, 301)} <= set(map(tuple, pairs.collect()))
    assert made(pairs._jdf.queryExecution().executedPlan()) <= classes.selectExpr("sum(size(keys))").first()[0]


def test_a_pair_is_judged_once(spark):
    docs = spark.createDataFrame([(i, "en", "the same few words " * 30 + "x" * (i % 3)) for i in range(9)], "doc_id long, lang string, text string")
    df = similarity.near_pairs(docs)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ratio" in plan and plan.count("ArrowEvalPython [") + plan.count("MapInArrow ratios") == 1
    spark.catalog.clearCache()


def cut(columns, types, size):
    n = len(columns[0])
    for k in range(0, n, size):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + size], t) for c, t in zip(columns, types, strict=True)], names=[f"c{i}" for i in range(len(columns))])


def test_keys_of_several_rows(monkeypatch):
    r = random.Random(2)
    monkeypatch.setattr(similarity, "HOT_ROWS", 5)
    for size in (1, 2, 3, 7, 100):
        for _ in range(40):
            keys = sorted(x for k in range(r.randrange(12)) for x in [k - 4] * r.choice([1, 1, 2, 4, 5, 6, 11, 13]))
            got = [tuple(x.values()) for b in similarity._several(cut([keys, range(len(keys))], [pa.int64()] * 2, size)) for x in b.to_pylist()]
            assert got == [(k, i, keys.count(k) > 5) for i, k in enumerate(keys) if keys.count(k) > 1]


def test_rows_of_a_key_meet(monkeypatch):
    r = random.Random(3)
    for most in (1, 10, 1 << 16):
        monkeypatch.setattr(similarity, "MET_PAIRS", most)
        for size in (1, 3, 50):
            rows = []
            for i in range(60):
                n = r.choice([40, 900, 901, 905, 1000, 5000, 5040, 5065, 70000])
                bag = [n // 32 + r.choice([0, 0, 1, 2]) for _ in range(31)]
                rows += [(k, r.choice([-1, 3]), n, i, [*bag, n - sum(bag)]) for k in r.sample(range(-2, 3), 2)]
            rows.sort(key=lambda x: x[:3])
            apart = lambda x, y: sum(min((a - b) % 256, (b - a) % 256) for a, b in zip(x, y, strict=True))
            want = {(min(x[3], y[3]), max(x[3], y[3])) for x in rows for y in rows if x[3] != y[3] and x[:2] == y[:2] and abs(x[2] - y[2]) <= 64 and max(apart(x[4], y[4]), abs(x[2] - y[2])) <= 0.005 * (x[2] + y[2]) + 1e-6}
            columns = [*zip(*rows, strict=True)]
            columns[4] = [bytes(c % 256 for c in bag) for bag in columns[4]]
            met = similarity._met(0.995, 64)(cut(columns, [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()], size))
            assert {tuple(x.values()) for b in met for x in b.to_pylist()} == want and len(want) > 5


def test_within():
    r = random.Random(4)
    for _ in range(2000):
        a = "".join(r.choice("aab c") for _ in range(r.randint(0, 60)))
        b = "".join(r.choice(["", c, c + "b"]) if r.random() < 0.1 else c for c in a) if r.random() < 0.8 else a[::-1]
        edits = round((1 - similarity.indel(a, b)) * (len(a) + len(b)))
        assert all(similarity.within(a, b, most) == (edits <= most) for most in {0, edits - 1, edits, edits + 1, edits + 9} if most >= 0)


def test_texts_of_no_pair_stay_where_they_are(spark):
    rows = spark.range(0, 40000, 1, 4).selectExpr("id AS doc_id", "'en' AS lang", "repeat(id, 3) AS text")
    ids = rows.select("doc_id").where("doc_id % 100 = 7")
    got = {r.doc_id for r in similarity._asked(rows, ids, 400).collect()}
    assert got >= set(range(7, 40000, 100)) and len(got) < 2000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = rows.withColumn("text", F.expr("CASE WHEN doc_id < 20 THEN repeat('the same words ', 40) || doc_id ELSE text END"))
        pairs = similarity.near_pairs(docs)
        assert pairs.where("ratio < 1").count() == 190
        plan = pairs.where("ratio < 1").select("left_id")
        assert plan.collect() and moved(plan._jdf.queryExecution().executedPlan()) < 90000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.catalog.clearCache()


def moved(plan):
    """Rows that all shuffles of an executed plan write."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return moved(plan.executedPlan())
    inner = [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return sum(map(moved, inner)) + (plan.metrics().get("shuffleRecordsWritten").get().value() if name == "ShuffleExchangeExec" else 0)
