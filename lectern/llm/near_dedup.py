"""MinHash near-duplicates: an LSH forest of sorted orders proposes, full shingle sets confirm, components of the links follow."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import answered, batch, binaries, bitmap, blocks, map_arrow, runs, saved, slots_for, texts, with_member
from lectern.llm.components import components
from lectern.llm.words import split_lower, window_hashes, word_hashes

SHINGLE = 5
#: Links need PERCENT * |union| <= 100 * |intersection|.
PERCENT = 75
#: Sorted signature orders, and labels that members of one region share at least; an order goes on with the labels of the next ones. A pair at the threshold shares no
#: region with probability (1 - 0.75 ** 4) ** 32, about 5 in a million.
TREES, DEPTH = 32, 4
HASHES = TREES * DEPTH
#: Equal signature bytes, of 128, below which a pair is not proposed: at the threshold 96 are expected, 5.3 deviations more.
AGREE = 70
#: Documents of a tile of a region, shingles on either side of a tile of a cluster, and rows of an order handled at once.
TILE_DOCS, TILE_SHINGLES, HELD_ROWS = 2048, 2_000_000, 1 << 18
BLOCK_BYTES = 4 << 20
_NULL_ID = np.iinfo(np.int64).min
_RNG = np.random.default_rng(20_200)
_XOR = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_MUL = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingle_sets(raw: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's sorted distinct hashes of ``size`` consecutive words; of its whole sequence where it has fewer."""
    h, n = word_hashes(raw, split_lower)
    every = window_hashes(h, size)
    at = 0
    for k in n.tolist():
        if k >= size:
            s = np.unique(every[at : at + k - size + 1])
        elif k:
            s = window_hashes(h[at : at + k], k) ^ np.uint64(k)
        else:
            s = np.zeros(0, np.uint64)
        at += k
        yield s


def signature(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, ((x[i : i + 1024] ^ _XOR) * _MUL).min(axis=0), out=out)
    return out


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, "raw", BLOCK_BYTES):
        sizes, digests, signs = [], [], []
        for s in shingle_sets(b.column(1).to_pylist()):
            sizes.append(len(s))
            digests.append(_digest(s) if len(s) else None)
            signs.append(signature(s).tobytes() if len(s) else None)
        yield batch(node=b.column(0), n=pa.array(sizes, pa.int64()), digest=binaries(digests), sign=binaries(signs))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _orders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's place in each order: a hash of its first ``DEPTH`` labels there, and a byte of each of the next 8."""
    for b in batches:
        if not b.num_rows:
            continue
        m, nodes = _matrix(b.column(1), np.uint32).astype(np.uint64), b.column(0).to_numpy()
        heads, tails = [], []
        for t in range(TREES):
            head, tail = np.full(len(m), t + 1, np.uint64), np.zeros(len(m), np.uint64)
            for c in range(t * DEPTH, (t + 1) * DEPTH):
                head = (head ^ m[:, c]) * np.uint64(0x9E3779B97F4A7C15)
                head ^= head >> np.uint64(29)
            for c in range((t + 1) * DEPTH, (t + 1) * DEPTH + 8):
                tail = tail << np.uint64(8) | m[:, c % HASHES] & np.uint64(255)
            heads.append(head.view(np.int64))
            # With the first bit turned, signed order is the order of the bytes.
            tails.append((tail ^ np.uint64(1 << 63)).view(np.int64))
        yield batch(head=pa.array(np.concatenate(heads)), tail=pa.array(np.concatenate(tails)), node=pa.array(np.tile(nodes, TREES)))


def common_prefix(tail: np.ndarray) -> np.ndarray:
    """Labels, 0 to 8, that each entry of a sorted order shares with the one before it."""
    x = tail.view(np.uint64)
    x = x[1:] ^ x[:-1]
    shared = np.full(len(tail), 8, np.int64)
    shared[:1] = 0
    for k in range(8):
        shared[1:][x >> np.uint64(56 - 8 * k) != 0] = np.minimum(shared[1:][x >> np.uint64(56 - 8 * k) != 0], k)
    return shared


def subregions(tail: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A region's sorted members cut into runs of at most ``most``, each cut where neighbours share the shortest prefix.

    So the depth grows only where a region is dense. A run also has the first member of the next one,
    so that every two neighbours of the order meet.
    """
    n, shared, out, start = len(tail), common_prefix(tail), [], 0
    while n - start > most:
        low = start + max(1, most // 2)
        stop = low + int(np.argmin(shared[low : start + most]))
        out.append((start, stop + 1))
        start = stop
    return [*out, (start, n)]


def _tiles(most: int):
    """Sorted orders to tiles. A region that fits one tile and lies within the partition is one; of any other the subregions
    are, and its members are also listed by region, since members of different subregions may be alike."""

    def name(nodes: np.ndarray) -> int:
        # After the set of members, so that orders which agree on a tile give it the same name.
        return int(np.add.reduce(window_hashes(nodes.view(np.uint64), 1)).view(np.int64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows, first = 0, True
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(tuple(b.column(i).to_numpy() for i in range(3)))
                rows += b.num_rows
                if rows < HELD_ROWS:
                    continue
            if not rows:
                return
            head, tail, node = (np.concatenate(x) for x in zip(*held, strict=True))
            begin = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
            stop = len(head) if b is None else int(begin[-1])
            held, rows = [(head[stop:], tail[stop:], node[stop:])], len(head) - stop
            begin = begin[begin < stop]
            size = np.diff(begin, append=stop)
            # The first and the last region of a partition may go on in its neighbours.
            cut = np.zeros(len(begin), bool)
            if len(begin):
                cut[0] |= first
                cut[-1] |= b is None
                first = False
            large = cut | (size > most)
            several = (size > 1) & ~large
            if several.any():
                names = np.add.reduceat(window_hashes(node[:stop].view(np.uint64), 1), begin).view(np.int64)
                n = int(size[several].sum())
                yield batch(tile=pa.array(np.repeat(names[several], size[several])), node=pa.array(node[:stop][np.repeat(several, size)]), region=pa.nulls(n, pa.int64()))
            for i in np.flatnonzero(large).tolist():
                members, tails = node[begin[i] : begin[i] + size[i]], tail[begin[i] : begin[i] + size[i]]
                for a, z in subregions(tails, most):
                    if z - a > 1:
                        yield batch(tile=pa.array(np.full(z - a, name(members[a:z]))), node=pa.array(members[a:z]), region=pa.nulls(z - a, pa.int64()))
                yield batch(tile=pa.nulls(len(members), pa.int64()), node=pa.array(members), region=pa.array(np.repeat(head[begin[i]], len(members))))

    return run


def across(members: DataFrame, found: DataFrame, most: int) -> DataFrame | None:
    """``tile, node``: tiles in which every two members of a region that lie in different components meet.

    ``members`` has ``region, node, weight``, each member of a region once; ``found`` has ``node,
    component``, a node that it lacks being its own. None where each region lies within one component.
    Small components share bins of weight ``most``, large ones are cut into parts of that; a tile is
    two of these units, so its weight is about twice ``most``.
    """
    known = members.join(found.select(F.col("node").alias("of"), "component"), F.col("node") == F.col("of"), "left").select("region", "node", "weight", F.coalesce("component", "node").alias("component"))
    known = saved(known, "members")
    per = known.groupBy("region", "component").agg(F.sum("weight").alias("heavy"), F.count(F.lit(1)).alias("rows"))
    small = F.sum(F.when(F.col("heavy") <= most, F.col("heavy")))
    bins = F.coalesce(F.ceil(small / most), F.lit(0)).cast("long")
    parts = F.ceil(F.col("heavy") / most).cast("long")
    several = per.groupBy("region").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("some"), bins.alias("bins"), F.sum(F.when(F.col("heavy") > most, parts).otherwise(0)).alias("in_parts"))
    several = saved(several.where("some > 1").select("region", "rows", "bins", (F.col("bins") + F.col("in_parts")).alias("units")), "regions")
    if several.isEmpty():
        return None
    large = per.where(F.col("heavy") > most).withColumn("parts", parts)
    before = F.sum("parts").over(Window.partitionBy("region").orderBy("component").rowsBetween(Window.unboundedPreceding, -1))
    large = large.select("region", "component", "rows", "parts", F.coalesce(before, F.lit(0)).alias("before"))
    asked = answered(known, several, ["region"], "rows", ["bins", "units"]).where("units IS NOT NULL")
    asked = answered(asked, large, ["region", "component"], "rows", ["parts", "before"])
    first = F.col("bins") + F.col("before")
    unit = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("component"), F.col("bins"))).otherwise(first + F.pmod(F.xxhash64("node"), F.col("parts")))
    every = F.sequence(F.lit(0).cast("long"), F.col("units") - 1)
    other = F.explode(F.filter(every, lambda x: F.col("parts").isNull() | (x < first) | (x >= first + F.col("parts"))))
    asked = asked.withColumn("unit", unit).withColumn("other", other)
    return asked.select(F.xxhash64("region", F.least("unit", "other"), F.greatest("unit", "other")).alias("tile"), "node")


def _stars(links: Iterable[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """What the links hold together, each node linked with nothing but the smallest one.

    Tiles that agree on a group thus give the same links, of which one stays, however many orders found it.
    """
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up[x]) != x:
            up[x] = x = up[y]
        return x

    def edges() -> pa.RecordBatch:
        out = [(y, x) for x in up if (y := top(x)) != x]
        up.clear()
        return batch(a=pa.array([a for a, _ in out], pa.int64()), b=pa.array([b for _, b in out], pa.int64()))

    for a, b in links:
        a, b = top(up.setdefault(a, a)), top(up.setdefault(b, b))
        up[max(a, b)] = min(a, b)
        if len(up) >= HELD_ROWS:
            yield edges()
    if up:
        yield edges()


def _proposed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that hold together what signatures in one tile say is similar: a spanning forest, not all pairs."""

    def links() -> Iterator[tuple[int, int]]:
        for t in runs(batches, ["tile"]):
            nodes = t.column("node").to_numpy()
            m = _matrix(t.column("bytes").combine_chunks(), np.uint8)
            left = np.arange(len(nodes))
            while len(left):
                stack, left = [int(left[0])], left[1:]
                while stack and len(left):
                    v = stack.pop()
                    near = (m[left] == m[v]).sum(axis=1) >= AGREE
                    if near.any():
                        found, left = left[near], left[~near]
                        yield from ((int(nodes[v]), int(nodes[i])) for i in found)
                        stack += found.tolist()

    return _stars(links())


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, "raw", BLOCK_BYTES):
        sets = list(shingle_sets(b.column(1).to_pylist()))
        yield batch(of=b.column(0), set_digest=binaries([_digest(s) for s in sets]), shingles=binaries([s.tobytes() for s in sets]))


def spanning_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets, each link checked on the full sets.

    Breadth first: a set taken up is compared with all that no set has reached yet.
    """
    size = np.array([len(s) for s in sets], np.int64)
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    flag = np.zeros(int(local.max()) + 1, bool)
    left = np.arange(len(sets))
    words, bounds = local, start[:-1]
    out = []
    while len(left):
        stack = [int(left[0])]
        left, words = left[1:], words[size[left[0]] :]
        bounds = bounds[1:] - size[stack[0]]
        while stack and len(left):
            v = stack.pop()
            mine = local[start[v] : start[v + 1]]
            flag[mine] = True
            common = np.add.reduceat(flag[words].astype(np.int64), bounds)
            flag[mine] = False
            near = 100 * common >= PERCENT * (size[v] + size[left] - common)
            if near.any():
                out += [(v, int(i)) for i in left[near]]
                stack += left[near].tolist()
                words = words[np.repeat(~near, size[left])]
                left = left[~near]
                bounds = np.cumsum(size[left]) - size[left]
    return out


def _confirmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def links() -> Iterator[tuple[int, int]]:
        for t in runs(batches, ["tile"]):
            nodes = t.column("node").to_pylist()
            if len(nodes) > 1:
                yield from ((nodes[i], nodes[j]) for i, j in spanning_links([np.frombuffer(x.as_py(), np.uint64) for x in t.column("shingles")]))

    return _stars(links())


def _low_bytes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            m = (_matrix(b.column(1), np.uint32) & np.uint32(255)).astype(np.uint8)
            yield batch(of=b.column(0), bytes=binaries([r.tobytes() for r in m]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile_docs: int = TILE_DOCS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if the Jaccard similarity of their sets of word 5-grams (A-Z in lower
    case) is at least 0.75; ``component_id`` is the smallest id reachable over links, and the
    document with that id is kept. Texts of fewer words have one shingle; null and empty texts have
    none and are linked with nothing.

    Documents with equal sets form a class, numbered by a hash of the set. The forest has ``TREES``
    orders of the classes, each sorted by its own sequence of MinHash labels; a region is a run of an
    order that shares ``DEPTH`` labels. Orders are cut into tasks by range, so a region may spread
    over several. In a region of up to ``tile_docs`` members all are candidates of each other; a
    denser one is cut deeper, into runs of neighbours with longer common prefixes, and where these
    are not all connected afterwards, members of its different components meet in tiles. Candidates
    are judged by their signatures, and a spanning forest of the proposed links leaves a task.
    Components of these are clusters. Their full sets meet in parts of bounded size, each with the
    cluster's first member; if that does not connect a cluster, members of its different components
    meet in tiles. Nothing caps how many partners a document has.

    Null ids count as one document with the smallest id; rows that repeat an id are handled by their
    text. Repeated rows give repeated rows, an empty input gives none, other columns are ignored.
    """
    rows = texts(docs, id_col, text_col).select(F.coalesce(F.col("doc_id"), F.lit(int(_NULL_ID))).alias("node"), F.col("text").cast("binary").alias("raw"))
    sketch = saved(map_arrow(rows, _sketch, "node long, n long, digest binary, sign binary"), "sketch")
    classes = sketch.where("n > 0").groupBy("digest").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sign").alias("sign"))
    classes = saved(classes.withColumn("node", F.xxhash64("digest")), "classes")
    low_bytes = map_arrow(classes.select(F.col("node").alias("of"), "sign"), _low_bytes, "of long, bytes binary")

    def proposed(tiles: DataFrame) -> DataFrame:
        tiles = tiles.join(low_bytes, F.col("node") == F.col("of")).select("tile", "node", "bytes")
        return map_arrow(tiles.repartition("tile").sortWithinPartitions("tile"), _proposed, "a long, b long")

    orders = map_arrow(classes.select("node", "sign"), _orders, "head long, tail long, node long")
    orders = orders.repartitionByRange("head", "tail", "node").sortWithinPartitions("head", "tail", "node")
    tiles = saved(map_arrow(orders, _tiles(tile_docs), "tile long, node long, region long"), "tiles")
    links = saved(proposed(tiles.where("tile IS NOT NULL").select("tile", "node").distinct()), "links")
    clusters = components(links)
    spread = tiles.where("region IS NOT NULL").select("region", "node", F.lit(1).cast("long").alias("weight"))
    if (more := across(spread, clusters, tile_docs)) is not None:
        clusters = components(links.unionByName(proposed(more)))
    clusters = clusters.join(classes.select(F.col("node").alias("of"), "n", "digest", "least"), F.col("node") == F.col("of")).select("node", F.col("component").alias("cluster"), "n", "digest", "least")
    clusters = saved(clusters, "clusters")
    slots = slots_for(clusters.count())

    def confirmed(asked: DataFrame) -> DataFrame:
        """Links among the members ``tile, node, digest, least`` that meet in a tile; texts are read again for their sets."""
        mine = with_member(rows, bitmap(asked, F.col("least"), slots=slots), "_hit", F.col("node"), slots=slots).where("_hit").select("node", "raw")
        sets = map_arrow(mine, _sets, "of long, set_digest binary, shingles binary").select("set_digest", "shingles").dropDuplicates(["set_digest"])
        joined = asked.join(sets, F.col("digest") == F.col("set_digest")).select("tile", "node", "shingles")
        return map_arrow(joined.repartition("tile").sortWithinPartitions("tile"), _confirmed, "a long, b long")

    weight = F.greatest("n", F.lit(max(1, tile_shingles // tile_docs)))
    parts = clusters.groupBy("cluster").agg(F.ceil(F.sum(weight) / (2 * tile_shingles)).alias("parts"), F.count(F.lit(1)).alias("rows"))
    split = answered(clusters, parts, ["cluster"], "rows", ["parts"])
    all_parts = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    # The first member of a cluster goes to each of its parts.
    part = F.explode(F.when(F.col("node") == F.col("cluster"), all_parts).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("parts")))))
    linked = saved(confirmed(split.select(part.alias("part"), "cluster", "node", "digest", "least").select(F.xxhash64("cluster", "part").alias("tile"), "node", "digest", "least")), "links")
    found = components(linked)
    split = split.where("parts > 1").select(F.col("cluster").alias("region"), "node", weight.alias("weight"))
    if (rest := across(split, found, tile_shingles)) is not None:
        rest = rest.join(clusters.select(F.col("node").alias("of"), "digest", "least"), F.col("node") == F.col("of")).select("tile", "node", "digest", "least")
        found = components(linked.unionByName(confirmed(saved(rest, "tiles"))))
    # Classes to the smallest id of their component; classes alone in theirs to their own smallest id.
    found = found.join(classes.select(F.col("node").alias("of"), "least", "digest", "copies"), F.col("node") == F.col("of")).select("digest", "component", "least", "copies")
    found = saved(found, "found")
    smallest = found.groupBy("component").agg(F.min("least").alias("smallest"), F.count(F.lit(1)).alias("rows"))
    named = answered(found, smallest, ["component"], "rows", ["smallest"]).select("digest", "smallest", "copies")
    alone = classes.where("copies > 1").join(found.select(F.col("digest").alias("_digest")), F.col("digest") == F.col("_digest"), "left_anti")
    named = named.unionByName(alone.select("digest", F.col("least").alias("smallest"), "copies"))
    # Texts without shingles get a key of their own, so that they spread evenly and meet no class.
    key = F.coalesce("digest", F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")).cast("binary"))
    out = answered(sketch.select("node", "n", key.alias("digest")), named, ["digest"], "copies", ["smallest"])
    component = F.coalesce("smallest", "node")
    shown = lambda c: F.when(c != int(_NULL_ID), c)
    return out.select(shown(F.col("node")).alias("doc_id"), F.col("n").alias("n_shingles"), shown(component).alias("component_id"), (F.col("node") == component).alias("kept"))
