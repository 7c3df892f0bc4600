"""Every registered corpus query: against its SQL, or against brute force over the same table."""

import hashlib
import zlib

import corpus_pipeline
import pytest
from lectern.llm.queries import ORACLES, QUERIES
from oracle import check
from test_scans import brute_base
from test_tokens import brute_padding


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library(bpe):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    check(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


def test_secrets(spark, sf_dir, rows):
    got = QUERIES["op6_secret_scan"](spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(rows) and len(got) == len(rows)
    for r in got:
        base = brute_base(rows[r.doc_id])
        said = [f"{k}:{a}:{z}" for a, z, k in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, _, k in base) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(",")) | {""}


def test_token_counts(spark, sf_dir, rows, library):
    got = QUERIES["op10_token_count"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {i: (len(t.encode()), n, n > 1024) for i, t in rows.items() for n in [len(library.encode(t, add_special_tokens=False).ids)]}


def test_token_shards(spark, sf_dir, rows, library):
    at, want = 0, {}
    for i in sorted(rows):
        ids = [*library.encode(rows[i], add_special_tokens=False).ids, 0]
        want[i] = (at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op4_token_shards"](spark, sf_dir).collect()} == want


def test_packing(spark, sf_dir, rows, library):
    got = QUERIES["op9_packing"](spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows.items()}
    assert len(got) == len(rows) and all(r.bucket_len - max(1, r.n_tokens) >= 0 for r in got)
    lengths = [max(1, r.n_tokens) for r in got]
    ends = sorted({r.bucket_len for r in got})
    assert all(r.bucket_len == min(e for e in ends if e >= max(1, r.n_tokens)) for r in got)
    # With 16 buckets brute force is out of reach; no bucket end can move to another length and lower the padding.
    cost = lambda some: sum(min(e for e in some if e >= n) - n for n in lengths)
    best, values = cost(ends), sorted(set(lengths))
    for k in range(len(ends) - 1):
        assert all(cost(sorted({*ends[:k], v, *ends[k + 1 :]})) >= best for v in values if v <= ends[-1])
    assert brute_padding([1, 2, 5], 2) == 1


@pytest.mark.parametrize(("name", "label", "folds", "out", "threshold"), [("op1_toxicity", "toxic", 3, 1, 0.7), ("op8_quality", "quality", 5, 0, 0.3)])
def test_classifiers(spark, sf_dir, rows, name, label, folds, out, threshold):
    got = QUERIES[name](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = [r.predicted == known[r.doc_id] for r in got if r.held_out and known.get(r.doc_id) is not None]
    assert sum(right) >= 0.75 * len(right)


def test_pipeline_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "packing"]
