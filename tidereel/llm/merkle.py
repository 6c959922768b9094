"""A Merkle manifest of a dataset: leaves, subroots of sources, one root, and an authentication path for each row.

The tree is ternary and has a subtree for each key (source). Rows get their
place under the key from sorted ranges. Every ``FAN ** HEIGHT`` rows of a key
are an aligned block. A first pass gives the blocks' roots; these are rows in
turn, and so on until each key has one node, and then over the keys. The way
down gives each block the path from its root to the top. The last pass goes
through the leaves of each block by fractal traversal: a stack of existing
subtrees, whose nodes are the path's siblings, and beside each the desired one
to its right, to which each step adds one leaf; so a path costs a few hashes
and a task holds a few subtrees. The block's own path comes behind each.

Digests are hashed as lower-case hex text and kept as 32 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

#: Children of a node, levels of a block, and levels of a stacked subtree.
FAN, HEIGHT, LEVELS = 3, 6, 2
#: Rows that a task hands on at once.
ROWS = 2_000


def joined(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def height_of(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


class Subtree:
    """Nodes of the levels from ``base`` up to below ``base + levels``, built leaf by leaf from ``start``.

    Below ``base`` only the open runs are held: one for each level.
    """

    def __init__(self, base: int, levels: int, start: int):
        self.base, self.top, self.start = base, base + levels, start
        self.runs: list[list[bytes]] = [[] for _ in range(self.top)]
        self.nodes: list[list[bytes]] = [[] for _ in range(levels)]

    def push(self, node: bytes, level: int = 0) -> None:
        while True:
            if level >= self.base:
                self.nodes[level - self.base].append(node)
            run = self.runs[level]
            run.append(node)
            if len(run) < FAN or level + 1 == self.top:
                return
            node, level = joined(run), level + 1
            run.clear()

    def finish(self) -> Subtree:
        """Closes the runs that the end of the leaves left open."""
        for level in range(self.top - 1):
            if self.runs[level]:
                node = joined(self.runs[level])
                self.runs[level].clear()
                self.push(node, level + 1)
        return self

    def root(self) -> bytes:
        return joined(self.finish().runs[self.top - 1])

    def siblings(self, leaf: int, out: list[bytes]) -> None:
        """Adds what stands beside the leaf's ancestors, level by level, from left to right."""
        place = leaf - self.start
        for level, nodes in enumerate(self.nodes, self.base):
            own = place // FAN**level
            low = own - own % FAN
            out += nodes[low:own]
            out += nodes[own + 1 : low + FAN]


def block_root(leaves: list[bytes], height: int) -> bytes:
    """The node ``height`` levels above; the leaf itself at height 0."""
    if height == 0:
        return leaves[0]
    tree = Subtree(height - 1, 1, 0)
    for x in leaves:
        tree.push(x)
    return tree.root()


def paths(leaves: list[bytes], height: int, levels: int = LEVELS) -> Iterator[bytes]:
    """The siblings of each leaf in turn, from its own up to below the block's root, by fractal traversal."""
    tiers = [(base, min(levels, height - base)) for base in range(0, height, levels)]
    span, n = [FAN ** (base + more) for base, more in tiers], len(leaves)
    existing = [Subtree(base, more, 0) for base, more in tiers]
    for width, tree in zip(span, existing, strict=True):
        for x in leaves[:width]:
            tree.push(x)
        tree.finish()
    desired = [Subtree(*tier, width) for tier, width in zip(tiers, span, strict=True)]
    for leaf in range(n):
        out: list[bytes] = []
        for tree in existing:
            tree.siblings(leaf, out)
        yield b"".join(out)
        for t, width in enumerate(span):
            if leaf + width < n:  # the leaf that lies one subtree ahead; leaf by leaf, the next subtree is whole when it is wanted
                desired[t].push(leaves[desired[t].start + leaf % width])
            if (leaf + 1) % width == 0 and leaf + 1 < n:
                existing[t] = desired[t].finish()
                desired[t] = Subtree(*tiers[t], leaf + 1 + width)


def folded(leaf: bytes, siblings: bytes, places: list[tuple[int, int]]) -> bytes:
    """The root that a leaf and its siblings give; ``places``: place and number of nodes in the tree of the key, then in that of the keys."""
    at = 0
    for place, n in places:
        while n > 1:
            low = place - place % FAN
            beside = min(FAN, n - low) - 1
            run = [siblings[k : k + 32] for k in range(at, at + 32 * beside, 32)]
            run.insert(place - low, leaf)
            leaf, at, place, n = joined(run), at + 32 * beside, place // FAN, -(-n // FAN)
    if at != len(siblings):
        raise ValueError("a path of another length")
    return leaf


def row_leaf(*columns: Column) -> Column:
    """Digest of a row's values: ``-`` for a null, else the UTF-8 byte count, a colon and the value as text."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place under the key from 0, and ``n``, the rows of the key.

    Rows are cut into ranges of key and order and sorted there; a row's place
    in its range is its number. A crowded key spreads over ranges: each range
    and key counts, and places go on from the ranges before.
    """
    ranged = rows.repartitionByRange(partitions(rows), key, *order).sortWithinPartitions(key, *order)
    ranged = stored(ranged.withColumn("__at", F.monotonically_increasing_id()))  # the range, then 33 bits for the row in it
    ranged = ranged.withColumn("__range", F.shiftright("__at", 33))
    heads = ranged.groupBy("__range", key).agg(F.min("__at").alias("__low"), F.count("*").alias("__own"))
    each = Window.partitionBy(key).orderBy("__range")
    heads = heads.select(
        "__range", key, "__low", F.coalesce(F.sum("__own").over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__own").over(Window.partitionBy(key)).alias("n"),
    )
    return ranged.join(heads, ["__range", key]).withColumn("pos", F.col("__at") - F.col("__low") + F.col("__before")).drop("__at", "__range", "__low", "__before")


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """``nodes(key, pos, n, digest, ...)`` dealt by aligned blocks and in order there."""
    return nodes.withColumn("block", F.floor(F.col("pos") / FAN**height)).repartition("key", "block")


def _grouped(batches, of: tuple[int, int]):
    """Rows of each run of equal key and block, as lists of columns; a block may go over several batches."""
    held, name = None, None
    for b in batches:
        keys, blocks = (b.column(k).to_pylist() for k in of)
        cuts = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1] or blocks[k] != blocks[k - 1]]
        for a, z in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            part, now = b.slice(a, z - a), (keys[a], blocks[a]) if len(keys) else None
            if held is not None and now == name:
                held.append(part)
                continue
            if held:
                yield pa.Table.from_batches(held).combine_chunks()
            held, name = [part], now
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _own_height(n: int, height: int) -> int:
    """A key of one block ends where one node is left; the blocks of a larger one all reach the full height."""
    return height_of(n) if n <= FAN**height else height


def block_roots(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``(key, pos, n, digest)`` of the aligned blocks of ``nodes(key, pos, n, digest)``."""

    def run(batches):
        for t in _grouped(batches, (0, 1)):
            n = t.column("n")[0].as_py()
            root = block_root(t.column("digest").to_pylist(), _own_height(n, height))
            yield pa.RecordBatch.from_arrays([t.column("key").chunk(0).slice(0, 1), t.column("block").chunk(0).slice(0, 1), pa.array([-(-n // FAN**height)], pa.int64()), pa.array([root], pa.binary())], names=["key", "pos", "n", "digest"])

    t = _blocks(nodes.select("key", "pos", "n", "digest"), height).select("key", "block", "pos", "n", "digest").sortWithinPartitions("key", "block", "pos")
    return t.mapInArrow(run, "key binary, pos long, n long, digest binary")


def _walked(nodes: DataFrame, above: DataFrame, height: int, levels: int) -> DataFrame:
    """``nodes`` with the other columns of ``above(key, block, up, ...)`` and ``siblings``: the path inside the block, then ``up``, that of the block."""
    more = [f for f in above.schema if f.name not in ("key", "block", "up")]
    given = [*nodes.schema, *more]
    names = [f.name for f in given]

    def run(batches):
        for t in _grouped(batches, (0, 1)):
            up, n = t.column("up")[0].as_py(), t.column("n")[0].as_py()
            walk, own = paths(t.column("digest").to_pylist(), _own_height(n, height), levels), t.select(names)
            for a in range(0, own.num_rows, ROWS):
                part = own.slice(a, ROWS)
                found = pa.array([next(walk) + up for _ in range(part.num_rows)], pa.binary())
                yield from part.append_column("siblings", found).combine_chunks().to_batches()

    t = _blocks(nodes, height).join(above, ["key", "block"]).select("key", "block", *names[1:], "up").sortWithinPartitions("key", "block", "pos")
    return t.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given) + ", siblings binary")


def _climbed(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of the blocks of these, and so on until each key has one node.

    A key that has its root sooner stays as a lone node, which no tier changes.
    """
    tiers = [nodes]
    while len(tiers) == 1 or not tiers[-1].where("n > 1").isEmpty():
        tiers.append(stored(block_roots(tiers[-1], height)))
    return tiers


def _descended(tiers: list[DataFrame], start: DataFrame, height: int, levels: int) -> DataFrame:
    """The nodes of the lowest tier with their paths; ``start(key, up, ...)`` has what stands above each key's root."""
    above = start.withColumn("block", F.lit(0).cast("long"))
    for t in reversed(tiers[1:-1]):
        more = [c for c in above.columns if c not in ("key", "block", "up")]
        walked = _walked(t.select("key", "pos", "n", "digest"), above, height, levels)
        above = stored(walked.select("key", F.col("pos").alias("block"), F.col("siblings").alias("up"), *more))
    return _walked(tiers[0], above, height, levels)


def authenticated(rows: DataFrame, key: Column, order: list[Column], digest: Column, height: int = HEIGHT, levels: int = LEVELS, **keep: Column) -> DataFrame:
    """``(*keep, leaf, pos, n, key_pos, keys, subroot, root, siblings)`` for each row.

    Rows of a key stand in the order of ``order``, nulls first, then of the
    digest, so a crowded place spreads over ranges; keys stand in the order of
    their UTF-8 bytes, null first. ``pos`` of ``n`` is a row's place under its
    key, ``key_pos`` of ``keys`` that of the key. ``siblings`` are the digests
    of the path joined, 32 bytes each, from the leaf's run up to the root.
    Rows that are alike each keep their place; an empty table gives an empty
    result; columns that aren't kept may have any names.
    """
    name = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")).cast("binary")
    places = [f"o{k}" for k in range(len(order))]
    leaves = rows.select(name.alias("key"), *[c.alias(p) for c, p in zip(order, places, strict=True)], digest.alias("digest"), F.struct(F.lit(1).alias("__"), *[c.alias(n) for n, c in keep.items()]).alias("kept"))
    leaves = numbered(stored(leaves), "key", [*places, "digest"]).select("key", "pos", "n", "digest", "kept")

    tiers = _climbed(leaves, height)
    keys = numbered(tiers[-1].select(F.lit(b"").alias("all"), "key", "digest"), "all", ["key"])
    upper = _climbed(stored(keys.select(F.col("all").alias("key"), "pos", "n", "digest", F.col("key").alias("of"))), height)
    heads = _descended(upper, upper[-1].select("key", F.lit(b"").alias("up"), F.col("digest").alias("root")), height, levels)
    heads = stored(heads.select(F.col("of").alias("key"), F.col("siblings").alias("up"), F.col("pos").alias("key_pos"), F.col("n").alias("keys"), F.col("digest").alias("subroot"), "root"))
    found = _descended(tiers, heads, height, levels)
    return found.select(*[F.col("kept")[n].alias(n) for n in keep], F.col("digest").alias("leaf"), "pos", "n", "key_pos", "keys", "subroot", "root", "siblings")


def with_folded_root(found: DataFrame, leaf: str, to: str = "folded_root") -> DataFrame:
    """Adds the root that the digest in ``leaf`` and the row's own path give."""
    names = ["pos", "n", "key_pos", "keys", "siblings"]
    given = [f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema]

    def run(batches):
        for b in batches:
            columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in (leaf, *names)]
            roots = [folded(x, siblings, [(pos, n), (k, keys)]) for x, pos, n, k, keys, siblings in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(roots, pa.binary())], names=[*b.schema.names, to])

    return found.mapInArrow(run, ", ".join([*given, f"`{to}` binary"]))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaf, roots, path and the verdict on a tampered text for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other, text = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.col("text")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(text, F.lit("\n"))
    forged = F.when(tampered, row_leaf(*other, F.replace(text, F.lit("\n"), F.lit(""))))
    found = authenticated(docs, F.col("source"), [F.col("doc_id")], row_leaf(*other, text), doc_id=F.col("doc_id"), forged=forged)
    out = with_folded_root(found.withColumn("shown", F.coalesce("forged", "leaf")), "shown")
    shown = lambda c: F.lower(F.hex(c))
    named = [shown(c).alias(c) for c in ("leaf", "subroot", "root")]
    return out.select("doc_id", *named, F.sha2(shown("siblings").cast("binary"), 256).alias("proof_sha256"), shown("folded_root").alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))
