"""Optimal length buckets: dynamic programming over a global histogram, then token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 16
#: Tokens, padding included, that a batch may hold.
BUDGET = 65_536
#: Batches that one window task numbers.
GROUP_BATCHES = 64


def best_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket lengths, ascending, that minimise the total padding of ``counts`` rows of each of the ascending ``lengths``.

    The cheapest way to fill k buckets with the first j lengths is the least over i of the cheapest
    way to fill k - 1 with the first i, plus ``lengths[j - 1] * (rows of i to j) - (tokens of them)``.
    For a given i that is a line in ``lengths[j - 1]``, with slopes that fall as i grows, so the lower
    envelope of the lines is walked once: linear time for each bucket.
    """
    n = len(lengths)
    if not n:
        return []
    u = lengths.tolist()
    c = [0, *np.cumsum(counts).tolist()]
    s = [0, *np.cumsum(counts * lengths).tolist()]
    cost: list[int | None] = [0] + [None] * n
    back = []
    for _ in range(min(buckets, n)):
        new: list[int | None] = [None] * (n + 1)
        at = [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # slope, height, i
        head = 0
        for j in range(1, n + 1):
            if cost[j - 1] is not None:
                m, b = -c[j - 1], cost[j - 1] + s[j - 1]
                # The last line goes if the one before it and the new one meet under it. Whole numbers: nothing is rounded.
                while len(hull) - head >= 2 and (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, b, j - 1))
            x = u[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                m, b, at[j] = hull[head]
                new[j] = m * x + b + x * c[j] - s[j]
        cost = new
        back.append(at)
    # More buckets never cost more, since each length has rows; walk back from all of them.
    out, j = [], n
    for at in reversed(back):
        out.append(u[j - 1])
        j = at[j]
    return out[::-1]


def pack_by_length(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, bucket_len, batch_id, slot, padding``.

    Each row goes to the shortest bucket that holds it; a batch has up to ``budget // bucket_len``
    rows of one bucket (one where a row is longer than the budget). The histogram that reaches the
    driver has a row for each different length, at most the square root of twice the number of all
    tokens; the padding is the least that so many buckets allow. Batches are formed in groups of
    about ``GROUP_BATCHES`` (a bucket's rows are dealt out by a hash), so no task holds a bucket; at
    most one batch of a group is not full. Rows are taken by length, then id.

    A null or zero length is padded as an empty row: it counts 0 tokens and needs length 1. Rows that
    repeat an id are packed one by one; a null id is an id. An empty input gives no rows; other
    columns are ignored.
    """
    rows = lengths.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"))
    rows = rows.withColumn("_needs", F.greatest("n_tokens", F.lit(1).cast("long")))
    histogram = sorted(rows.groupBy("_needs").count().collect())
    lengths, counts = (np.array([r[i] for r in histogram], np.int64) for i in range(2))
    ends = best_buckets(lengths, counts, buckets)
    held = np.diff(np.searchsorted(lengths, ends, "right"), prepend=0)
    sizes = np.add.reduceat(counts, np.concatenate([[0], np.cumsum(held)[:-1]])) if ends else []
    if not ends:
        ends, sizes = [1], [0]
    which = F.array(*[F.lit(e).cast("long") for e in ends])
    place = F.aggregate(which, F.lit(1), lambda a, e: a + F.when(e < F.col("_needs"), 1).otherwise(0))
    rooms = [max(1, budget // e) for e in ends]
    groups = [max(1, -(-int(n) // (r * GROUP_BATCHES))) for n, r in zip(sizes, rooms, strict=True)]
    rows = rows.withColumn("_place", place)
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("_place"))
    rows = rows.select("doc_id", "n_tokens", pick(ends).alias("bucket_len"), pick(rooms).alias("_room"), F.pmod(F.xxhash64("doc_id", "n_tokens"), pick(groups)).alias("_group"))
    number = F.row_number().over(Window.partitionBy("bucket_len", "_group").orderBy("n_tokens", "doc_id")) - 1
    rows = rows.withColumn("_n", number)
    batch = F.concat_ws("-", "bucket_len", "_group", F.floor(F.col("_n") / F.col("_room")).cast("string"))
    return rows.select("doc_id", "n_tokens", "bucket_len", batch.alias("batch_id"), F.pmod(F.col("_n").cast("long"), F.col("_room")).alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
