"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken ``target / source size`` times: a
whole number of copies and a fractional probability. Within a bucket of
documents, fractional ones meet in pairs, all pairs of a round at once; a
random transfer of mass (probability times size) keeps the joint mass of a
pair and makes one of the two whole. One residual is left for each bucket; the
residuals meet in a reduction tree whose levels are grouped jobs, until one is
left for each source. Rows that repeat id, source and size are numbered, so
that they spread over the buckets like any others.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, partitions

WEIGHTS, CAP = (5, 2, 1), 3
#: Documents that a bucket holds on average, and residuals that meet at a node of the tree.
BUCKET_ROWS, FAN_IN = 1_000, 64
#: Repeated rows that a task writes out at once.
REPEATS = 1_000
#: The table of targets is broadcast up to so many bytes; beyond them a source's rows are joined in so many parts.
BROADCAST_BYTES, SALTS = 8 << 20, 64
_TINY = 1e-12


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``sizes(source, size)`` to ``(source, source_size, n_rows, target)``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    the whole size; a target stops at ``cap`` times its source's size and the
    excess is shared anew. The level at which all is shared is the largest of
    the levels reached when sources are capped in order of size by weight. The
    windows run over one row for each source.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    per = per.select("*", w.alias("w"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(rest)
    per = per.select("*", level.alias("level"))
    return per.select("source", "source_size", "n_rows", F.least(F.col("source_size") * float(cap), F.max("level").over(every) * F.col("w")).alias("target"))


def round_pairs(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Whole 0 or 1 for each item but one, and the place of that one (-1 if none); ``p`` of that one is updated in the result.

    The fractional items of a round are paired in order and all pairs are
    settled together; each round leaves at most half of them, so there are
    about log2(n) rounds.
    """
    p = np.where(size > 0, p, 0.0).astype(float)

    def fractional() -> np.ndarray:
        return np.flatnonzero((p > _TINY) & (p < 1 - _TINY))

    left = fractional()
    while len(left) > 1:
        i, j = left[0 : len(left) // 2 * 2 : 2], left[1::2]
        a, b = size[i].astype(float), size[j].astype(float)
        up, down = np.minimum(a * (1 - p[i]), b * p[j]), np.minimum(a * p[i], b * (1 - p[j]))
        move = np.where(rng.random(len(i)) * (up + down) < down, up, -down)
        p[i] += move / a
        p[j] -= move / b
        left = fractional()
    whole = (p <= _TINY) | (p >= 1 - _TINY)
    p[whole] = np.round(p[whole])
    return p, int(left[0]) if len(left) else -1


def _with_targets(rows: DataFrame, targets: DataFrame, small: bool) -> DataFrame:
    """Joins the targets by ``key``; the rows of one source never meet in one task for that."""
    if small:
        return rows.join(F.broadcast(targets), "key")
    salted = targets.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id", "size", "copy"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def numbered_items(sizes: DataFrame) -> DataFrame:
    """``(key, id, size, copy)`` for each row: rows alike in all are counted from 0.

    Only counts are shuffled; a count is written out in parts that are dealt
    to the tasks, so no row that repeats often lands in one of them.
    """
    same = sizes.groupBy("key", "id", "size").agg(F.count("*").alias("m"))
    parts = same.select("key", "id", "size", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(REPEATS).cast("long"))).alias("at"))
    parts = parts.repartition(partitions(sizes), "key", "id", "size", "at")
    return parts.select("key", "id", "size", F.explode(F.sequence("at", F.least(F.col("at") + REPEATS, F.col("m")) - 1)).alias("copy"))


def mix(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, bucket_rows: int = BUCKET_ROWS, seed: int = 7) -> DataFrame:
    """``sizes(id, source, size)`` to ``(id, source, size, source_size, target, copies)``, one row for each.

    The sum of copies times size of a source differs from its target by less
    than one document. Draws depend on ids, sources, sizes and the seed only,
    so reruns agree, however the table is cut. Null ids and sources are values
    like any other; documents of size 0 get no copy; an empty table gives an
    empty result; columns but the three named are not read.
    """
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key")
    sizes = durable(sizes.select("id", "source", key, F.col("size").cast("long").alias("size")))
    targets = durable(source_targets(sizes, weights, cap).select("*", key))
    buckets = F.ceil(F.col("n_rows") / bucket_rows)
    seen = targets.agg(F.max(buckets).alias("widest"), F.sum(2 * F.octet_length("key") + 64).alias("bytes")).first()
    small, widest = (seen.bytes or 0) <= BROADCAST_BYTES, seen.widest or 1
    keyed = _with_targets(numbered_items(sizes), targets, small)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-9)
    rows = keyed.select("key", "id", "size", "copy", whole.cast("int").alias("whole"), F.greatest(rate - whole, F.lit(0.0)).alias("p"), F.pmod(F.xxhash64(F.lit(seed), "key", "id", "size", "copy"), buckets).alias("bucket"))
    kind = sizes.schema["id"].dataType.simpleString()
    out_schema = f"key string, id {kind}, size long, copy long, whole int, p double, bucket long"

    def round_bucket(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["id", "size", "copy"], na_position="first", ignore_index=True)
            rng = np.random.default_rng(zlib.crc32(f"{seed}/{level}/{pdf['key'].iat[0]}/{pdf['bucket'].iat[0]}".encode()))
            pdf["p"], left = round_pairs(pdf["size"].to_numpy(), pdf["p"].to_numpy(), rng)
            if left >= 0 and pdf["whole"].iat[left] >= cap:  # never above the cap
                pdf.loc[left, "p"] = 0.0
            return pdf

        return run

    level, done, n = 0, [], int(widest)
    while True:
        rounded = durable(rows.groupBy("key", "bucket").applyInPandas(round_bucket(level), out_schema))
        fractional = (F.col("p") > _TINY) & (F.col("p") < 1 - _TINY)
        if n == 1:
            chance = F.pmod(F.xxhash64(F.lit(seed), "key", "id", "size", "copy"), F.lit(1 << 30)) / float(1 << 30)
            done.append(rounded.select("key", "id", "size", "copy", (F.col("whole") + F.when(fractional, (chance < F.col("p")).cast("int")).otherwise(F.round("p").cast("int"))).alias("copies")))
            break
        done.append(rounded.where(~fractional).select("key", "id", "size", "copy", (F.col("whole") + F.round("p").cast("int")).alias("copies")))
        rows = rounded.where(fractional).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        n, level = -(-n // FAN_IN), level + 1
    taken = done[0]
    for d in done[1:]:
        taken = taken.unionByName(d)
    return _with_targets(taken, targets, small).select("id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("copies")).otherwise(0).cast("int").alias("copies"))


def n_words(text: str = "text") -> Column:
    """Words of the whole text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def op6_pivotal_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, with its source's size and target."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "source", n_words().alias("size"))
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
