"""Token counts, shards and packing."""

import random
import zlib

import numpy as np
import pytest

from lectern.llm.bpe import Encoder
from lectern.llm.packing import best_buckets, pack_by_length
from lectern.llm.token_count import count_tokens
from lectern.llm.wavelet import WaveletMatrix, from_bytes, read_token_shards, to_bytes, write_token_shards


@pytest.fixture(scope="module")
def enc(bpe):
    return Encoder(bpe)


def test_pieces_equal_library(enc):
    r = random.Random(0)
    parts = [" ", "  ", "   ", "\n", "a", "B", "é", "中", "1", ".", "'s", "\t", " ", "<|endoftext|>", "foo", "!!", "　", "😀", "'", "\x1c", "\x85", "\r\n"]
    texts = ["", *("".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000))]
    ids, n = enc.encode_block(texts)
    ends = np.cumsum(n)
    for t, a, z in zip(texts, ends - n, ends, strict=True):
        assert ids[a:z].tolist() == enc.whole(t).tolist(), repr(t)


def test_marks_and_lines_equal_library(enc):
    r = random.Random(2)
    parts = ["word", "The", "é", "ß", "ª", " ", " ", " ", "\n", "\n\n", ".", ",", "$$$", "'", "'ll", "_", "23", "\x00", "\x1f"]
    texts = ["", *("".join(r.choice(parts) for _ in range(r.choice([1, 2, 5, 20, 80]))) for _ in range(3000))]
    ids, n = enc.encode_block(texts)
    want = [enc.whole(t) for t in texts]
    assert n.tolist() == list(map(len, want))
    assert np.array_equal(ids, np.concatenate(want))


class Told:
    """The library, with a list of what it was asked to encode."""

    def __init__(self, library):
        self.library, self.texts = library, []

    def encode_batch_fast(self, texts, **how):
        self.texts += texts
        return self.library.encode_batch_fast(texts, **how)


def letters(r):
    return "".join(r.choice("abcdeé") for _ in range(8))


def test_known_parts_are_not_encoded_again(bpe):
    """Word, marks, line end and word: the library sees the parts, not each way to put them together."""
    r = random.Random(5)
    words = [letters(r) for _ in range(30)]
    enc = Encoder(bpe)
    enc.encode_block([" ".join(["x", *words, *(w + m for w in words[:3] for m in (".", "!?", "###"))]), *words])
    told = enc.library = Told(enc.library)
    texts = ["x " + " ".join(f"{a}{m}\n{b}{n}" for a, b in zip(words, r.sample(words, 30), strict=True)) for m in (".", "!?", "") for n in ("", ".", "###")]
    ids, n = enc.encode_block(texts)
    assert sum(map(len, told.texts)) < 10
    assert np.array_equal(ids, np.concatenate([enc.whole(t) for t in texts])) and n.sum() == len(ids)


def test_frequent_pieces_stay_when_others_go(bpe):
    r = random.Random(6)
    often = [letters(r) for _ in range(20)]
    enc = Encoder(bpe, 60)
    for k in range(6):
        told = Told(enc.library)
        enc.library = told
        text = "x " + " ".join([*often, *often, *(letters(r) for _ in range(50))])
        ids, _ = enc.encode_block([text])
        assert k == 0 or not {x for t in told.texts for x in t.split()} & set(often)
        enc.library = told.library
        assert ids.tolist() == enc.whole(text).tolist()
        assert len(enc.memo) < 60 + 60


@pytest.mark.parametrize(("window", "overlap"), [(16, 2), (50, 7), (200, 20)])
def test_resync_equals_library(enc, window, overlap):
    r = random.Random(1)
    parts = ["word ", "  ", "\n\n ", "中文", "a.b ", "'t ", "<|endoftext|>", " x"]
    for t in ["a" * 400, " " * 300, "中" * 300, *("".join(r.choice(parts) for _ in range(150)) for _ in range(40))]:
        assert enc.resync(t, window, overlap).tolist() == enc.whole(t).tolist()


def test_count(docs, nasty, empty, enc, bpe):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, bpe, window=500, overlap=40).collect())
    assert got == sorted((str(r[0]), len((r[1] or "").encode()), len(enc.whole(r[1] or "")), len(enc.whole(r[1] or "")) > 1024) for r in nasty)
    assert count_tokens(empty, bpe).count() == 0


def test_count_sentencepiece(unique):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = {r.doc_id: len(sp.encode(r.text or "")) for r in unique.collect()}
    assert {r.doc_id: r.n_tokens for r in count_tokens(unique, path).collect()} == want


def test_wavelet_queries():
    a = np.random.default_rng(0).integers(0, 40, 3000).astype(np.uint32)
    w, ids, ends = from_bytes(to_bytes(WaveletMatrix.build(a), [7, None], np.array([1, 3000])))
    assert ids == [7, None] and ends.tolist() == [1, 3000] and w.tokens().tolist() == a.tolist()
    assert [w.access(i) for i in range(0, 3000, 41)] == a[::41].tolist()
    for s in (0, 5, 39, 41, 5000):
        places = np.flatnonzero(a == s).tolist()
        assert w.count(s) == len(places) and [w.select(s, k) for k in range(len(places))] == places
        assert w.select(s, len(places)) == -1 and w.rank(s, 1000) == sum(p < 1000 for p in places)
    with pytest.raises(IndexError):
        w.access(3000)
    assert len(WaveletMatrix.build(np.zeros(0, np.uint32)).tokens()) == 0


def test_shards(unique, empty, docs, nasty, enc, bpe):
    rows = sorted((r.doc_id, r.text or "") for r in unique.collect())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_token_shards(write_token_shards(unique, bpe, shard_bytes=2000)).collect())
    at, want = 0, []
    for i, t in rows:
        ids = np.append(enc.whole(t), 0).astype("<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert read_token_shards(write_token_shards(docs, bpe)).count() == len(nasty)
    assert read_token_shards(write_token_shards(empty, bpe)).count() == 0


def brute_padding(lengths, k):
    import itertools

    values = sorted(set(lengths))
    best = None
    for some in itertools.combinations(values[:-1], min(k, len(values)) - 1):
        ends = [*some, values[-1]]
        cost = sum(min(e for e in ends if e >= n) - n for n in lengths)
        best = cost if best is None else min(best, cost)
    return best


def test_buckets_are_optimal():
    r = random.Random(3)
    for _ in range(30):
        lengths = [r.randint(1, 12) ** 2 for _ in range(r.randint(1, 30))]
        uppers, counts = np.unique(lengths, return_counts=True)
        for k in (1, 2, 3, 4):
            ends = best_buckets(uppers, counts, k)
            assert ends[-1] == max(lengths) and len(ends) == min(k, len(uppers))
            assert sum(min(e for e in ends if e >= n) - n for n in lengths) == brute_padding(lengths, k)


def test_packing(spark, empty):
    r = random.Random(5)
    rows = [(i, r.choice([0, 1, 7, 100, 101, 900, 5000]) + r.randint(0, 3)) for i in range(700)] + [(None, 3), (1, None), (5, 70_000)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = pack_by_length(df, buckets=4, budget=4096).collect()
    assert len(got) == len(rows)
    sizes = {}
    for x in got:
        assert x.bucket_len >= max(1, x.n_tokens) and x.padding == x.bucket_len - x.n_tokens
        sizes.setdefault(x.batch_id, []).append(x)
    assert len({x.bucket_len for x in got}) <= 4
    for batch in sizes.values():
        assert len({x.bucket_len for x in batch}) == 1 and sorted(x.slot for x in batch) == list(range(len(batch)))
        assert len(batch) * batch[0].bucket_len <= max(4096, batch[0].bucket_len)
    assert pack_by_length(df.limit(0)).count() == 0
