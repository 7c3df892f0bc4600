"""Bit-planes are parted by positions: random bits cost boolean masks a wrong guess at every other id."""

import time

import numpy as np

from lectern.llm.wavelet import SPAN, WaveletMatrix


def masked(ids):
    """The same planes, and the ids back, by boolean masks."""
    now, planes = ids.astype(np.uint16), []
    for b in range(15, -1, -1):
        bit = (now & np.uint16(1 << b)) != 0
        packed = np.packbits(bit, bitorder="little")
        planes.append(np.concatenate([packed, np.zeros(-len(packed) % (SPAN // 8), np.uint8)]))
        now = np.concatenate([now[~bit], now[bit]])
    now = np.zeros(len(ids), np.uint16)
    for b, packed in enumerate(reversed(planes)):
        bit = np.unpackbits(packed, bitorder="little", count=len(ids)).view(bool)
        up, z = np.empty_like(now), int((~bit).sum())
        up[~bit] = now[:z]
        up[bit] = now[z:] | np.uint16(1 << b)
        now = up
    return planes, now


def test_planes_cost_less_than_by_masks():
    ids = np.random.default_rng(3).integers(0, 1 << 16, 600_000).astype(np.uint32)
    ids[0] = (1 << 16) - 1

    def seconds(work):
        begun = time.thread_time()
        return work(), time.thread_time() - begun

    ours, theirs = [], []
    for _ in range(4):
        matrix, a = seconds(lambda: WaveletMatrix.build(ids))
        back, b = seconds(matrix.tokens)
        (planes, want), c = seconds(lambda: masked(ids))
        ours.append(a + b)
        theirs.append(c)
    assert np.array_equal(back, ids) and np.array_equal(want, ids)
    assert all(np.array_equal(p, q) for p, q in zip(matrix.planes, planes, strict=True))
    assert min(ours) < 0.8 * min(theirs)


def test_parts_of_any_size_give_the_same_planes(monkeypatch):
    r = np.random.default_rng(4)
    for n in (0, 1, 6, 7, 8, 14, 15, 600):
        ids = r.integers(0, 50_000, n).astype(np.uint32)
        want = WaveletMatrix.build(ids)
        monkeypatch.setattr("lectern.llm.wavelet.PART", 7)
        got = WaveletMatrix.build(ids)
        assert all(np.array_equal(p, q) for p, q in zip(got.planes + got.ranks, want.planes + want.ranks, strict=True))
        assert np.array_equal(got.tokens(), ids)
        monkeypatch.undo()
