"""Near copies by SimHash near-dedup with verified similarity, as the pipeline needs it.

1. Texts with the same set of shingles become one node with a SimHash.
2. The vantage-point search of ``simhash`` links close fingerprints; each of
   its links is kept only if the shingle sets have the similarity.
3. At a Jaccard similarity of 0.8 fingerprints differ in about ten bits, more
   than any bound lets a search of 64 bits prune. So MinHash bands name the
   candidates that are still apart: at similarity J two nodes share one with
   probability ``1 - (1 - J ** ROWS) ** BANDS``, 0.9999 at J 0.8, more above.
4. Buckets whose members have one smallest neighbour need nothing more. In the
   others each pair that is still apart is compared in the first bucket that it
   shares; tasks hold two parts of a bucket at most. Pairs are passed over whose
   sizes or parity bits can't have the similarity: each shingle that only one of
   two sets has changes one bit, so the bits that differ are never more than
   those shingles. Members with a pair left get their sets and are compared
   exactly; a spanning forest of the links is handed on, never pairs.
5. Star contraction joins the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import durable, partitions, text_bytes
from .components import connected_components

SEED = 42
BANDS, ROWS = 30, 6
#: Members of a part of a bucket, and bits of the fingerprints within which the first links are sought.
PART, BITS = 1_024, 4
#: Longs of parity bits for each set.
LONGS = 8
_DRAWN = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS, 1), dtype=np.uint64)
_XOR, _ODD = _DRAWN[0], _DRAWN[1] * np.uint64(2) + np.uint64(1)
#: Shingles that are permuted at once.
_BLOCK = 1 << 10
#: Texts whose sets a task holds at once.
_TEXTS = 512


def shingles(data: bytes, size: int) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; a shorter text is one shingle, one without words none."""
    words = data.lower().split()  # bytes: A-Z only, ASCII blanks only
    hashes = (xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), SEED) for i in range(max(1, len(words) - size + 1)))
    return np.unique(np.fromiter(hashes, np.uint64)) if words else np.zeros(0, np.uint64)


def bands(h: np.ndarray) -> np.ndarray:
    """One signed number for each band of the set's MinHash; none for an empty set."""
    if not len(h):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(h), _BLOCK):
        x = (h[None, i : i + _BLOCK] ^ _XOR) * _ODD
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=1))
    digests = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(digests, np.uint64).view(np.int64)


def parity(h: np.ndarray) -> np.ndarray:
    """Whether the set has an odd number of shingles, for each value of their low bits."""
    odd = np.bincount((h & np.uint64(64 * LONGS - 1)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _key(h: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh128_intdigest(h.tobytes())
    return _signed(d >> 64), _signed(d & (2**64 - 1))


def _nodes(rows: DataFrame, size: int) -> DataFrame:
    """``rows(id, t)`` to one row for each set of shingles: ``(node, id, n, fp, g, bands)``, id being the smallest."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in (b.slice(i, _TEXTS) for b in batches for i in range(0, b.num_rows, _TEXTS)):
            sets = [shingles(t.as_buffer().to_pybytes(), size) for t in b.column(1)]
            keys = [_key(h) for h in sets]
            columns = [
                pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(h) for h in sets], pa.int32()),
                pa.array([_signed(simhash.majority(h)) for h in sets], pa.int64()), pa.array([parity(h).tobytes() for h in sets], pa.binary()), pa.array([bands(h).tobytes() for h in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["id", "k1", "k2", "n", "fp", "g", "bands"])

    prints = rows.mapInArrow(run, f"id {kind}, k1 long, k2 long, n int, fp long, g binary, bands binary")
    groups = prints.groupBy("k1", "k2").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "fp", "g", "bands")])
    return durable(groups.withColumn("node", F.monotonically_increasing_id()).drop("k1", "k2"))


def _buckets(nodes: DataFrame) -> DataFrame:
    """``(h, node)`` for each band of each node."""

    def run(batches):
        for b in batches:
            h = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1)]
            at = np.repeat(np.arange(len(h)), [len(x) for x in h])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *h])), b.column(0).take(pa.array(at))], names=["h", "node"])

    return nodes.select("node", "bands").mapInArrow(run, "h long, node long")


def _sets(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(node, s)`` for ``wanted(node, id)``: the sets of shingles."""

    def run(batches):
        for b in (b.slice(i, _TEXTS) for b in batches for i in range(0, b.num_rows, _TEXTS)):
            sets = [shingles(t.as_buffer().to_pybytes(), size).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    return durable(rows.join(wanted, "id").select("node", "t").mapInArrow(run, "node long, s array<long>").dropDuplicates(["node"]))


def close_pairs(n: np.ndarray, g: np.ndarray, tenths: int, block: int = 128):
    """Index pairs (i < j) whose sizes and parity bits allow the similarity."""
    for s in range(0, len(n), block):
        i = np.arange(s, min(s + block, len(n)))
        differ = np.zeros((len(i), len(n)), np.int64)
        for k in range(g.shape[1]):
            differ += np.bitwise_count(g[i, None, k] ^ g[None, :, k])
        total = n[i, None] + n[None]
        may = ((10 + tenths) * differ <= (10 - tenths) * total) & (10 * np.minimum(n[i, None], n[None]) >= tenths * np.maximum(n[i, None], n[None]))
        p, q = np.nonzero(may)
        yield i[p][q > i[p]], q[q > i[p]]


def open_pairs(h: int, c: np.ndarray, side: np.ndarray, n: np.ndarray, g: np.ndarray, band: np.ndarray, tenths: int):
    """Index pairs of a bucket, or between two parts of it (``side`` 0 and 1), that are apart in ``c``, may link and share no earlier bucket."""
    two = side.any() and not side.all()
    for i, j in close_pairs(n.astype(np.int64), g, tenths):
        ok = c[i] != c[j]
        if two:
            ok &= side[i] != side[j]
        i, j = i[ok], j[ok]
        for s in range(0, len(i), 1 << 16):
            a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            first = band[a, (band[a] == band[b]).argmax(axis=1)] == h
            yield a[first], b[first]


def bucket_links(pairs, node: np.ndarray, c: np.ndarray, n: np.ndarray, sets: list, tenths: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``pairs``, beyond those in ``c``."""
    group = dict(zip(c.tolist(), c.tolist(), strict=True))
    held: dict[int, set] = {}

    def top(x: int) -> int:
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    def of(i: int) -> set:
        if i not in held:
            held[i] = set(sets[i].tolist())
        return held[i]

    links = []
    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            u, v = top(int(c[x])), top(int(c[y]))
            if u != v and (10 + tenths) * len(of(x) & of(y)) >= tenths * int(n[x] + n[y]):
                group[max(u, v)] = min(u, v)
                links.append((int(node[x]), int(node[y])))
    return links


def _each_part(members: DataFrame, settle, schema: str) -> DataFrame:
    """``settle`` over the rows of each part of a bucket; it gets a table and gives one."""
    key = ["h", "i", "j"]

    def run(batches):
        held = None

        def give(t):
            of = [t.column(k).to_numpy() for k in key]
            cut = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in of], axis=0)])
            done = [settle(t.slice(a, b - a)) for a, b in zip(cut, np.r_[cut[1:], t.num_rows], strict=True) if b - a > 1]
            if done := [x for x in done if x.num_rows]:
                yield from pa.concat_tables(done).combine_chunks().to_batches()

        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            if not t.num_rows:
                continue
            at = int(np.flatnonzero(np.all([(k := t.column(x).to_numpy()) == k[-1] for x in key], axis=0))[0])
            if at:
                yield from give(t.slice(0, at))
            held = t.slice(at)
        if held is not None:
            yield from give(held)

    return members.repartition(partitions(members), *key).sortWithinPartitions(*key).mapInArrow(run, schema)


def _pairs_of(t: pa.Table, tenths: int):
    g, band = (np.stack([np.frombuffer(x, d) for x in t.column(k).to_pylist()]) for k, d in (("g", np.uint64), ("bands", np.int64)))
    return open_pairs(t.column("h")[0].as_py(), t.column("c").to_numpy(), t.column("side").to_numpy(), t.column("n").to_numpy(), g, band, tenths)


def _still_open(members: DataFrame, tenths: int) -> DataFrame:
    """The rows of ``members(h, i, j, node, c, side, n, g, bands)`` that have a pair left to compare."""

    def settle(t: pa.Table) -> pa.Table:
        seen = np.zeros(t.num_rows, bool)
        for a, b in _pairs_of(t, tenths):
            seen[a] = seen[b] = True
        return t.select(["h", "i", "j", "node", "c", "side"]).filter(pa.array(seen))

    return _each_part(members, settle, "h long, i long, j long, node long, c long, side int")


def _compare(members: DataFrame, tenths: int) -> DataFrame:
    """``members(h, i, j, node, c, side, n, g, bands, s)`` to the links of each part."""

    def settle(t: pa.Table) -> pa.Table:
        sets = [np.asarray(x.values) for x in t.column("s").combine_chunks()]
        links = bucket_links(_pairs_of(t, tenths), t.column("node").to_numpy(), t.column("c").to_numpy(), t.column("n").to_numpy(), sets, tenths)
        return pa.table({k: pa.array([x[p] for x in links], pa.int64()) for p, k in enumerate("uv")})

    return _each_part(members, settle, "u long, v long")


def near_copies(docs: DataFrame, size: int, tenths: int, text_col: str = "text") -> DataFrame:
    """``docs(id, text)`` to ``(id, others)``: the smallest id of each group of near copies, and how many distinct sets it stands for.

    Two texts link at a Jaccard similarity of ``tenths`` / 10 or more. Equal ids
    must have equal texts and no id may be null. Texts without words are copies
    of each other. An empty table gives an empty result; repeated rows count
    once; other columns may have any names.
    """
    rows = docs.select("id", text_bytes(text_col).alias("t"))
    nodes = _nodes(rows, size)
    points = durable(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    close = simhash.near_fingerprints(points.select("fp"), BITS)
    head = lambda c: points.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
    pairs = close.join(head("u"), "u").join(head("v"), "v").select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))
    pairs = pairs.unionByName(nodes.join(points, "fp").where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")))
    pairs = durable(pairs.distinct())

    banded = _buckets(nodes)
    shared = banded.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    live = durable(banded.join(durable(shared), "h"))
    wanted = live.select("node").unionByName(pairs.select(F.col("u").alias("node"))).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    sets = _sets(rows, wanted.join(nodes.select("node", "id"), "node"), size)

    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("sv")), "v")
    same, total = F.size(F.array_intersect("su", "sv")), F.size("su") + F.size("sv")
    found = durable(both.where((10 + tenths) * same >= tenths * total).select("u", "v"))
    near = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
    reach = near.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("component"))  # a step is enough to see most of what is joined

    named = durable(live.join(reach, "node", "left").select("h", "node", "m", F.coalesce("component", "node").alias("c")))
    mixed = durable(named.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("h"))
    parts = F.ceil(F.col("m") / PART)
    open_ = named.join(mixed, "h").select("h", "node", "c", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).alias("own"))
    met = open_.select("h", "node", "c", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    met = met.select("h", "node", "c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    prints = nodes.select("node", "n", "g", "bands")
    left = _still_open(met.join(prints, "node"), tenths)
    members = left.join(prints, "node").join(sets, "node")
    reach = connected_components(found.unionByName(_compare(members, tenths)))
    return nodes.join(reach, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("id").alias("id"), F.count("*").alias("others")).select("id", "others")
