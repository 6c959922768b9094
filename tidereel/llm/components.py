"""Connected components of a link table, as alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


#: Links that a task contracts; a table of no more is settled by one task.
TASK_LINKS = 20_000


def _contract(batches):
    """The links of a partition as stars around the smallest node of each group that they join."""
    group: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := group.setdefault(x, x)) != x:
            group[x] = x = group[y]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if (a := top(u)) != (c := top(v)):
                group[max(a, c)] = min(a, c)
    stars = np.array([(u, v) for u in list(group) if (v := top(u)) != u], np.int64).reshape(-1, 2)
    for k in range(0, len(stars), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(stars[k : k + (1 << 16), c]) for c in (0, 1)], names=["u", "v"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(u, v)``, longs, to ``(node, component)``, component being the smallest node reachable.

    In each round tasks contract bounded shares of the links in place, which
    leaves few rounds. Only nodes that have a link appear. Links stay in Spark: each round joins
    the links to the smallest neighbour of each node, which is aggregated
    before it is shuffled. Those smallest neighbours are written durably, so
    that the join has a shuffle of its own on both sides and the skew join can
    split a hub's rows. Nulls and loops are dropped; an empty table gives an
    empty result.
    """
    e = links.where("u is not null and v is not null and u <> v").select("u", "v").distinct()
    e = durable(e)
    state = _state(e)
    for _ in range(max_rounds):
        tasks = -(-state[0] // TASK_LINKS)
        if tasks == 0:
            break
        e = e.coalesce(tasks).mapInArrow(_contract, "u long, v long")
        if tasks == 1:
            e = durable(e)
            break
        e = durable(e.distinct())
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))  # a node meets few smallest neighbours here
        pairs = large.join(low, "u")
        small = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = durable(small)
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
