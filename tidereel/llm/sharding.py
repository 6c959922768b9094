"""Shards as runs of a Hilbert curve over document metadata.

Source, language and size are quantised by rank; the Hilbert index of the
three gives an order in which documents with like metadata lie together, so
the files of a shard carry narrow ranges of each column. Equal texts are one
group and never part. Large groups are placed first, in the run that they lie
in if it has room; the others are cut into runs that fill the shards to one
level of bytes. Positions come from a range shuffle and sums of the ranges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import durable, partitions

BITS = 5
#: A group of equal texts above one part of so many of a shard, by bytes or rows, is large: at most 2 x shards x PARTS groups are.
PARTS = 64


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each row of ``axes`` (non-negative, under ``2 ** bits``): axes to transposed index, then bits interleaved."""
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


@F.pandas_udf(LongType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([a.to_numpy(), b.to_numpy(), c.to_numpy()], axis=1), BITS))


def _above(x: Column, bounds: list) -> Column:
    """How many of the bounds lie below ``x`` or at it."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= x)) if bounds else F.lit(0)


def _named(c: str) -> Column:
    """A metadata value without nulls."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def _rank_bounds(rows: DataFrame, c: str, weighed: bool = False) -> list:
    """Values that cut the sorted distinct ones (all rows, if ``weighed``) into even ranks, repeated where there are few.

    All values are counted, in ranges of their order: only a sum for each range and the bounds reach the driver.
    """
    levels = 1 << BITS
    tally = _ranged(rows.groupBy(c).agg((F.count("*") if weighed else F.lit(1).cast("long")).alias("n")), [c])
    total, before = 0, {}
    for x in tally.groupBy("pid").agg(F.sum("n").alias("n")).orderBy("pid").collect():
        before[x.pid] = total
        total += x.n
    if not total:
        return []
    wanted = [k * total // levels for k in range(1, levels)]
    starts = rows.sparkSession.createDataFrame(list(before.items()), "pid int, n0 long")
    end = F.col("n0") + F.sum("n").over(Window.partitionBy("pid").orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
    placed = tally.join(F.broadcast(starts), "pid").select(c, "n", end.alias("end"))
    met = F.filter(F.array(*[F.lit(w) for w in wanted]), lambda w: (w >= F.col("end") - F.col("n")) & (w < F.col("end")))
    return sorted(r[0] for r in placed.select(F.col(c).alias("v"), F.explode(met)).collect())


def level_of(used: list[int], more: int) -> float:
    """The level to which ``more`` fills vessels that hold ``used``."""
    low = sorted(used)
    for k in range(1, len(low) + 1):
        level = (sum(low[:k]) + more) / k
        if k == len(low) or level <= low[k]:
            break
    return level


def place_large(large: list[tuple[int, float]], shards: int, mean: float) -> list[int]:
    """Shard of each ``(bytes, place on the curve from 0 to 1)``, given largest first: its own run if it has room, else the emptiest."""
    used, out = [0] * shards, []
    for size, at in large:
        own = min(int(at * shards), shards - 1)
        if used[own] and used[own] + size > mean:
            own = min(range(shards), key=lambda s: (used[s], abs(s - own)))
        used[own] += size
        out.append(own)
    return out


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` cut into ranges of ``order``, with the number of the range as ``pid``, written durably."""
    return durable(df.repartitionByRange(partitions(df), *order).withColumn("pid", F.spark_partition_id()))


def curve_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``(id, size, text_crc32, curve, shard, slot)`` for each row; size is the text's UTF-8 bytes plus 1.

    Law: bytes. Equal texts share a shard always, at the place of their
    smallest source and language. Shards differ by no more than a 32nd of
    their level, unless a group of equal texts alone rises above it: that
    shard is then as large as its groups and the others share the rest evenly.
    Nulls in a metadata column are one more value, a null text is an empty
    one; repeated rows take slots of their own; an empty table gives an empty
    result; other columns may have any names; a very long text counts by its
    size alone and is never shuffled. Metadata values and sizes are ranked whole
    and over all rows, however many there are. Ranges are cut by all sort
    columns and the row's number, so neither a crowded cell of the curve nor a
    group of copies lands in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = durable(
        docs.select(
            F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"), _named(source_col).alias("source"), _named(lang_col).alias("lang"), F.monotonically_increasing_id().alias("row"),
        )
    )
    group = ["h", "text_crc32", "size"]
    cell = _curve(
        _above(F.col("source"), _rank_bounds(rows, "source")).cast("long"),
        _above(F.col("lang"), _rank_bounds(rows, "lang")).cast("long"),
        _above(F.col("size"), _rank_bounds(rows, "size", weighed=True)).cast("long"),
    )
    groups = rows.groupBy(*group).agg(F.min("source").alias("source"), F.min("lang").alias("lang"), F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups = durable(groups.select(*group, "bytes", "n", cell.alias("curve")))
    cells = groups.groupBy("curve").agg(F.sum("bytes").alias("b"), F.sum("n").alias("n")).orderBy("curve").collect()  # one row for each cell of the curve
    total, count = sum(x.b for x in cells), sum(x.n for x in cells)
    before, start = {}, 0
    for x in cells:
        before[x.curve] = start / max(total, 1)
        start += x.b
    is_large = (F.col("bytes") * (shards * PARTS) > total) | (F.col("n") * (shards * PARTS) > count)
    large = sorted(groups.where(is_large).collect(), key=lambda x: (-x.bytes, x.curve, x.h, x.text_crc32))
    placed = place_large([(x.bytes, before[x.curve]) for x in large], shards, total / shards)
    used = [sum(x.bytes for x, s in zip(large, placed, strict=True) if s == k) for k in range(shards)]
    level = level_of(used, total - sum(used))
    ends = [sum(max(0.0, level - u) for u in used[: k + 1]) for k in range(shards - 1)]
    spark = docs.sparkSession
    big = spark.createDataFrame([(x.h, x.text_crc32, x.size, x.curve, s) for x, s in zip(large, placed, strict=True)], "h long, text_crc32 long, size long, curve long, shard int")

    line = ["curve", *group]
    small = _ranged(groups.where(~is_large).select(*line, "bytes"), line)
    each = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = small.groupBy("pid").agg(F.sum("bytes").alias("b")).select("pid", F.coalesce(F.sum("b").over(each), F.lit(0)).alias("b0"))  # a row for each range
    inside = Window.partitionBy("pid").orderBy(*line).rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("b0") + F.sum("bytes").over(inside) - F.col("bytes")
    small = small.join(F.broadcast(sums), "pid").select(*line, _above(at.cast("double"), ends).cast("int").alias("shard"))

    big = F.broadcast(big)
    rows = rows.select("id", "row", *group)
    dealt = rows.join(big, group).unionByName(rows.join(big.select(*group), group, "left_anti").join(small, group))
    order = ["shard", *line, "id", "row"]
    dealt = _ranged(dealt.select(*order), order)
    heads = dealt.groupBy("pid", "shard").agg(F.count("*").alias("n"))  # a row for each range and shard in it
    each = Window.partitionBy("shard").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("pid", "shard", F.coalesce(F.sum("n").over(each), F.lit(0)).alias("n0"))
    slot = F.col("n0") + F.row_number().over(Window.partitionBy("pid", "shard").orderBy(*order)) - 1
    return dealt.join(F.broadcast(heads), ["pid", "shard"]).select("id", "size", "text_crc32", "curve", "shard", slot.alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The documents as Parquet, a folder for each shard, each file sorted along the curve. Ids must be unique."""
    spots = placed.select(F.col("id").alias(id_col), "shard", "slot")
    docs.join(spots, id_col).repartitionByRange(partitions(docs), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    """Shard and slot of each document."""
    out = curve_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
