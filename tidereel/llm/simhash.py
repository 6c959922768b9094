"""Near duplicates by SimHash fingerprints, searched with vantage-point trees.

1. Each text gets a 64-bit fingerprint from the XXH64 of its word shingles.
2. Fingerprints are made distinct, so a group of exact copies is one point.
3. The bits are cut into blocks. Two fingerprints that differ in k bits agree in
   all but k blocks, so they meet in a group that agrees in the others. With
   k + 1 blocks a point has k + 1 copies; one more block is cut only when the
   groups would grow beyond a shard (at about 2 ** 28 points for k = 4).
4. A group that is larger than a shard is partitioned by a vantage-point tree
   over Hamming distance, fitted on a bounded sample. Each point lives in one
   shard and visits those across a boundary that the triangle bounds cannot
   rule out.
5. Each shard is joined with itself and its visitors by a vantage-point
   recursion that prunes by the same bounds; it compares pairs exactly and
   hands on a spanning forest of the links found, never all pairs.
6. Star contraction gives each document the smallest id it can reach.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, partitions, text_bytes
from .components import connected_components

SEED = 42
#: Rows whose shingle bits are unpacked at once.
_BLOCK = 1 << 15


def fingerprint(data: bytes, shingle: int = 4) -> int:
    """The unsigned fingerprint of one text; zero where it has no word."""
    words = data.lower().split()  # bytes: A-Z only, ASCII blanks only
    if not words:
        return 0
    joined, xx = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return xx(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    h = np.fromiter((xx(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is set if it is in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _BLOCK):
        ones += np.unpackbits(h[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` for every row; ``fp`` is the fingerprint's bits as a signed long. A null text counts as empty."""

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def _far(x: np.ndarray, p: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ p).astype(np.int16)


class ShardTree:
    """A complete vantage-point tree of ``depth`` levels over a sample; its leaves are the shards."""

    def __init__(self, sample: np.ndarray, depth: int, k: int):
        self.depth, self.k = depth, k
        inner = 2**depth - 1
        self.point, self.radius = np.zeros(inner, np.uint64), np.full(inner, 31, np.int16)
        sets = {0: sample}
        for node in range(inner):
            x = sets.pop(node)
            if len(x):
                trial = x[:: max(1, len(x) // 16)][:16]
                self.point[node] = max(trial, key=lambda p: float(_far(x, p).std()))  # a wide spread prunes best
                d = _far(x, self.point[node])
                self.radius[node] = int(np.median(d))
                near = d <= self.radius[node]
                sets[2 * node + 1], sets[2 * node + 2] = x[near], x[~near]
            else:
                sets[2 * node + 1] = sets[2 * node + 2] = x

    def deal(self, x: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, node, visits)``: the node at ``depth`` where each point lives, and each node beyond a boundary that it must visit.

        Of two near points on different sides of a boundary, the inner one visits.
        """
        row, node, visits = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        for _ in range(self.depth if depth is None else min(depth, self.depth)):
            d, r = np.bitwise_count(x[row] ^ self.point[node]).astype(np.int16), self.radius[node]
            near, far = d <= r, d > r
            into_near = np.where(visits, d - self.k <= r, near)
            into_far = np.where(visits, d + self.k > r, far)
            crosses = ~visits & near & (d + self.k > r)
            row, node, visits = (
                np.concatenate([row[into_near], row[into_far], row[crosses]]),
                np.concatenate([2 * node[into_near] + 1, 2 * node[into_far] + 2, 2 * node[crosses] + 2]),
                np.concatenate([visits[into_near], visits[into_far], np.ones(int(crosses.sum()), bool)]),
            )
        return row, node, visits


def block_masks(points: int, k: int, shard_points: int) -> np.ndarray:
    """Bits that a group agrees in, for each choice of the blocks that may differ; any two points within ``k`` bits agree in one of them."""
    blocks = next((m for m in range(k + 1, 64) if points <= shard_points * 2 ** (64 * (m - k) / m)), 64)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return np.array([sum(c) for c in combinations(parts, blocks - k)], np.uint64)


class _Forest:
    """Labels of points that links have joined so far, and the links that joined them."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            high, low = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((low, high))
            first = order[np.r_[True, high[order][1:] != high[order][:-1]]]  # each label hooks onto one lower label
            self.links.append((i[first], j[first]))
            to = np.arange(len(self.label))
            to[high[first]] = low[first]
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]


def near_links(x: np.ndarray, resident: np.ndarray, k: int, leaf: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links at ``k`` or fewer bits between residents, and between visitors and residents."""
    forest = _Forest(len(x))

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        for s in range(0, len(a), 256):
            for t in range(0, len(b), 8192):
                p, q = np.nonzero(np.bitwise_count(x[a[s : s + 256], None] ^ x[None, b[t : t + 8192]]) <= k)
                forest.add(a[s + p], b[t + q])

    def brute(a: np.ndarray, b: np.ndarray) -> None:
        """All pairs but those of two points that the links found so far have joined to the largest group here."""
        name, size = np.unique(np.concatenate([forest.label[a], forest.label[b]]), return_counts=True)
        group = name[size.argmax()]
        ina, inb = forest.label[a] == group, forest.label[b] == group
        compare(a[ina], b[~inb])
        compare(a[~ina], b)

    work = [(np.flatnonzero(resident), None), (np.flatnonzero(~resident), np.flatnonzero(resident))]
    while work:
        a, b = work.pop()
        if not len(a) or (b is not None and not len(b)):
            continue
        first = forest.label[a[0]]
        if (forest.label[a] == first).all() and (b is None or (forest.label[b] == first).all()):
            continue  # joined already
        pool = a if b is None or len(a) >= len(b) else b
        if len(pool) <= leaf:
            brute(a, a if b is None else b)
            continue
        pivot = pool[len(pool) // 2]
        p = x[pivot]
        da, db = _far(x[a], p), None if b is None else _far(x[b], p)
        close = np.concatenate([a[da <= k], *([] if b is None else [b[db <= k]])])
        forest.add(np.full(len(close), pivot), close)
        r = int(np.median(_far(x[pool], p)))
        if b is None:
            parts = [(a[da <= r], None), (a[da > r], None), (a[(da <= r) & (da + k > r)], a[(da > r) & (da - k <= r)])]
        else:
            parts = [
                (a[da <= r], b[db <= r]),
                (a[da > r], b[db > r]),
                (a[(da <= r) & (da + k > r)], b[(db > r) & (db - k <= r)]),
                (a[(da > r) & (da - k <= r)], b[(db <= r) & (db + k > r)]),
            ]
        pairs = len(a) * len(a if b is None else b) / (2 if b is None else 1)
        left = sum(len(u) * len(u if v is None else v) / (2 if v is None else 1) for u, v in parts)
        if left > 0.95 * pairs:  # no bound rules anything out: one close cluster
            brute(a, a if b is None else b)
        else:
            work += parts
    if not forest.links:
        return np.zeros(0, int), np.zeros(0, int)
    return tuple(np.concatenate(z) for z in zip(*forest.links, strict=True))


def group_links(x: np.ndarray, group: np.ndarray, resident: np.ndarray, k: int, few: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of the links inside each run of equal ``group``; small groups are compared side by side."""
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(x) else np.zeros(0, np.int64)
    size = np.diff(np.r_[cut, len(x)])
    number = np.repeat(np.arange(len(cut)), size)
    small, forest = np.repeat(size <= few, size), _Forest(len(x))
    for d in range(1, int(min(few, size.max(initial=0)))):
        i = np.flatnonzero(small[:-d] & (number[:-d] == number[d:]))
        i = i[np.bitwise_count(x[i] ^ x[i + d]) <= k]
        forest.add(i, i + d)
    us, vs = [u for u, _ in forest.links], [v for _, v in forest.links]
    for a, n in zip(cut[size > few], size[size > few], strict=True):
        u, v = near_links(x[a : a + n], resident[a : a + n], k)
        us.append(a + u)
        vs.append(a + v)
    return tuple(np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs))


def near_fingerprints(points: DataFrame, max_distance: int = 4, shard_points: int = 1 << 15, sample_points: int = 1 << 14) -> DataFrame:
    """``points(fp)``, distinct, to ``(u, v)``: links that join whatever is within ``max_distance`` bits, directly or in steps.

    ``sample_points`` bounds the fingerprints that the driver sees to fit the
    tree of the large groups; its depth is bounded by that sample, a level for
    each doubling.
    """
    k, masks = max_distance, block_masks(points.count(), max_distance, shard_points)

    def blocks(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for c, m in enumerate(masks):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), c, np.int32)), pa.array((fp & m).view(np.int64)), b.column(0)], names=["combo", "value", "fp"])

    dealt = points.select("fp").mapInArrow(blocks, "combo int, value long, fp long")
    large = durable(dealt.groupBy("combo", "value").agg(F.count("*").alias("n")).where(F.col("n") > shard_points))
    widest = large.agg(F.max("n")).first()[0]
    key = ["combo", "value", "node"]
    if widest is None:
        dealt = dealt.select("combo", "value", F.lit(0).cast("long").alias("node"), F.lit(True).alias("resident"), "fp")
    else:
        sample = np.array([r.fp for r in points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample_points).collect()], np.int64).view(np.uint64)
        tree = ShardTree(sample, min(math.ceil(math.log2(widest / shard_points)), max(1, len(sample).bit_length() - 1)), k)

        def split(batches):
            for b in batches:
                combo, value, fp, depth = (b.column(c).to_numpy(zero_copy_only=False) for c in range(4))
                for d in np.unique(depth):
                    mine = np.flatnonzero(depth == d)
                    for s in range(0, len(mine), 4096):
                        at = mine[s : s + 4096]
                        row, node, visits = tree.deal(fp[at].view(np.uint64), int(d))
                        at = at[row]
                        yield pa.RecordBatch.from_arrays([pa.array(combo[at]), pa.array(value[at]), pa.array(node), pa.array(~visits), pa.array(fp[at])], names=[*key, "resident", "fp"])

        depth = F.coalesce(F.ceil(F.log2(F.col("n") / shard_points)), F.lit(0)).cast("int")
        dealt = dealt.join(large, ["combo", "value"], "left").select("combo", "value", "fp", depth.alias("depth")).mapInArrow(split, "combo int, value long, node long, resident boolean, fp long")

    def search(batches):
        """Rows come in order of their groups; a group that goes on in the next batch waits for it."""
        held = None

        def give(t):
            kind = [t.column(c).to_numpy() for c in range(3)]
            fresh = np.r_[True, np.any([c[1:] != c[:-1] for c in kind], axis=0)]
            fp = t.column(4).to_numpy()
            u, v = group_links(fp.view(np.uint64), np.cumsum(fresh), t.column(3).to_numpy(), k)
            return pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[v])], names=["u", "v"])

        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
            if not t.num_rows:
                continue
            same = np.all([t.column(c).to_numpy() == t.column(c)[t.num_rows - 1].as_py() for c in range(3)], axis=0)
            at = int(np.flatnonzero(same)[0])
            if at:
                yield give(t.slice(0, at).combine_chunks())
            held = t.slice(at).combine_chunks()
        if held is not None:
            yield give(held)

    return dealt.repartition(partitions(points), *key).sortWithinPartitions(*key).mapInArrow(search, "u long, v long")


def link_components(fps: DataFrame, max_distance: int = 4, **sizes) -> DataFrame:
    """``fps(id, fp)`` to ``(id, fp, component_id)``.

    Rows without an id keep their fingerprint; their component is that of the
    ids that they are near to, or null.
    """
    groups = durable(fps.groupBy("fp").agg(F.min("id").alias("node")))
    reach = connected_components(near_fingerprints(groups.select("fp"), max_distance, **sizes))
    named = groups.join(reach, groups["fp"] == reach["node"].alias("x"), "left").select(groups["fp"], groups["node"], F.coalesce(reach["component"], groups["fp"]).alias("c"))
    named = durable(named)
    ids = durable(named.groupBy("c").agg(F.min("node").alias("component_id")))  # so that both sides of the join have a shuffle of their own, and a large component's rows can be split
    known = named.join(ids, "c").select("fp", "component_id")
    return fps.join(known, "fp").select("id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component_id)`` for every row of ``docs``; other columns may have any names.

    Null and empty texts have fingerprint zero and link like any other. An
    empty table gives an empty result; repeated rows each keep their row; very
    long texts are read whole, a text at a time in its task.
    """
    return link_components(durable(fingerprints(docs, shingle, id_col, text_col)), max_distance)


def hex16(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def op1_simhash_vptree(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of each document."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), hex16().alias("fingerprint"), "component_id")
