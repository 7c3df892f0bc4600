"""The pipeline's filtering stages on rows that share an id or have none."""

import random

import corpus_pipeline
from lectern.llm.quality import score_quality, train_quality

SF = "/root/testdata/sf0.001"


def kept(spark, stage, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string").repartition(3)
    return sorted(map(tuple, stage(spark, docs, SF).collect()), key=str)


def test_rows_fall_for_their_own_text(spark, monkeypatch):
    r = random.Random(9)
    say = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(80))
    a, b, c, d, e = (say() for _ in range(5))
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    order = lambda rows: sorted(rows, key=str)
    rows = [(None, a, "1"), (None, b, "2"), (7, a, "3"), (5, a, "4"), (5, c, "5"), (None, None, "6"), (9, "", "7")]
    assert kept(spark, corpus_pipeline.exact_dedup, rows) == order([rows[1], rows[2], rows[4], rows[6]])
    rows = [(None, a, "1"), (None, b, "2"), (3, near(a), "3"), (3, c, "4"), (2, near(c), "5"), (1, d, "6"), (1, near(d), "7"), (None, near(b), "8"), (4, e, "9"), (None, None, "10")]
    got = kept(spark, corpus_pipeline.near_dedup, rows)
    # Of near texts under one id either may stay, of the others the smallest id.
    assert len(got) == 6 and set(got) >= {rows[0], rows[4], rows[8], rows[9]}
    assert len(set(got) & {rows[1], rows[7]}) == len(set(got) & {rows[5], rows[6]}) == 1 and rows[3] not in got and rows[2] not in got
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, item, "1"), (None, a, "2"), (4, item, "3"), (4, b, "4"), (None, None, "5")]
    assert kept(spark, corpus_pipeline.decontaminate, rows) == order([rows[1], rows[3], rows[4]])
    known = spark.read.parquet(f"{SF}/documents.parquet")
    model = train_quality(known, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {x.predicted: known.where(f"doc_id = {x.doc_id}").first().text for x in score_quality(known, model).collect()}
    monkeypatch.setattr(corpus_pipeline, "train_quality", lambda *_: model)
    rows = [(None, texts[0], "1"), (None, texts[1], "2"), (4, texts[0], "3"), (4, texts[1], "4")]
    assert kept(spark, corpus_pipeline.quality, rows) == order([rows[1], rows[3]])
