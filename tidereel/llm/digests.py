"""Document fingerprints as quartile bucket digests.

Hashed byte triplets of the text are counted in 256 buckets. The digest keeps
the quartile of each bucket (two bits) and the length on a logarithmic scale.
Two digests are compared by a difference score with a fixed upper bound.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from .common import durable, partitions

BUCKETS = 256
#: The mean difference of two independent quartile codes is 1.25; at or beyond that nothing is alike.
BOUND = BUCKETS * 1.25
LENGTH_STEP, LENGTH_WEIGHT, LENGTH_CAP = 1.1, 2, 32
#: Characters of a batch that a task hands back.
BLOCK_CHARS = 1_000_000
#: Bytes of text that a range of ids has on average, at most.
RANGE_BYTES = 64 << 20


def digest(data: bytes) -> str:
    """130 hex digits: the length code, then 256 quartile codes. Texts under three bytes have no triplet: all codes are 0."""
    count, a = np.zeros(BUCKETS, np.int64), np.frombuffer(data, np.uint8)
    for i in range(0, max(0, len(a) - 2), 1 << 20):
        x = a[i : i + (1 << 20) + 2].astype(np.uint32)
        count += np.bincount(((x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS)
    cut = np.sort(count)[[BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4]]
    code = (count[:, None] > cut).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    body = code[:, 0] << 6 | code[:, 1] << 4 | code[:, 2] << 2 | code[:, 3]
    return f"{min(255, round(math.log(len(data) + 1, LENGTH_STEP))):02x}{body.tobytes().hex()}"


def _codes(d: str) -> tuple[int, np.ndarray]:
    b = np.frombuffer(bytes.fromhex(d[2:]), np.uint8)
    return int(d[:2], 16), np.stack([b >> 6, b >> 4 & 3, b >> 2 & 3, b & 3]).astype(np.int16)


def likeness(one: str, two: str) -> float:
    """1 for equal digests, 0 at the bound or beyond."""
    if one == two:
        return 1.0
    (m, a), (n, b) = _codes(one), _codes(two)
    return 1 - min(float(np.abs(a - b).sum()) + LENGTH_WEIGHT * min(abs(m - n), LENGTH_CAP), BOUND) / BOUND


def _listed(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds lie below the key, by binary search."""
    steps = [1 << j for j in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: at + F.when(F.get(_listed(bounds), at + s - 1) < key, s).otherwise(0))


def _numbers(rows: DataFrame) -> DataFrame:
    """``(id, h, k)``: each pair of an id and a hash of the text has a number ``k`` in the order of both, nulls first."""
    pairs = rows.select("id", F.xxhash64("t").alias("h")).distinct()
    return durable(pairs.repartitionByRange(partitions(rows), "id", "h").sortWithinPartitions("id", "h").withColumn("k", F.monotonically_increasing_id()))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows ``(b, ghost, k, id, t)``, dealt and sorted so that each row's successor by id follows it in its bucket.

    Ids are cut into ranges, one to a task and of about ``range_bytes`` of text
    where the input has more than the session's shuffle partitions would hold;
    the first row of each range also goes to the range before, as a ghost (the
    very first to the last range). Texts are shuffled once. Only the bounds and
    first ids of the ranges reach the driver.

    Ids that aren't whole numbers, and tables where the rows of one id have
    more than ``range_bytes`` of text, are cut by numbers that stand for id and
    text; texts are shuffled once more to get them. Only rows alike in both
    are then bound to one range.
    """
    low = -(2**63)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    size, most = rows.groupBy("id").agg(F.sum(F.octet_length("t")).alias("n")).agg(F.sum("n"), F.max("n")).first()
    if isinstance(docs.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType)) and (most or 0) <= range_bytes:
        rows = rows.withColumn("k", F.coalesce(F.col("id").cast("long"), F.lit(low)))
        keys = rows.select("k")
    else:
        numbers = _numbers(rows)
        keys, n = numbers.select("k"), numbers.select(F.col("id").alias("__id"), "h", "k")
        rows = rows.join(n, F.col("id").eqNullSafe(F.col("__id")) & (F.xxhash64("t") == F.col("h"))).select("id", "t", "k")
    buckets = buckets or max(partitions(docs), -(-(size or 0) // range_bytes))
    cuts = keys.agg(F.percentile_approx("k", [(i + 1) / buckets for i in range(buckets - 1)] or [0.5], max(10_000, 20 * buckets))).first()[0]
    bounds = sorted(set(cuts or [0]))
    at = _range_of(F.col("k"), bounds)
    heads = keys.groupBy(at.alias("b")).agg(F.min("k").alias("k")).orderBy("b").collect()
    first, to = [low] * (len(bounds) + 1), list(range(len(bounds) + 1))
    for i, h in enumerate(heads):
        first[h.b], to[h.b] = h.k, heads[i - 1].b
    rows = rows.withColumn("at", at)
    home = F.struct(F.col("at").alias("b"), F.lit(False).alias("ghost"))
    visit = F.struct(F.get(_listed(to), F.col("at")).cast("int").alias("b"), F.lit(True).alias("ghost"))
    rows = rows.select("k", "id", "t", F.explode(F.when(F.col("k") == F.get(_listed(first), F.col("at")), F.array(home, visit)).otherwise(F.array(home))).alias("z"))
    return rows.select("z.b", "z.ghost", "k", "id", "t").repartitionById(len(bounds) + 1, F.col("b")).sortWithinPartitions("b", "ghost", "k", F.xxhash64("t"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next)`` for each row.

    The edited text ends in the beginning of the next document's. Ids may be of
    any type that can be sorted. A null text is empty; rows of one id, repeated
    rows too, follow one another in the order of a hash of the text; a null id
    comes first; a lone row is its own successor; an empty table gives no row.
    Texts are taken whole, however long; other columns, of any name, are left
    behind.
    """
    names = ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        waiting, out, size = None, [], 0
        for batch in batches:
            arrow_id = batch.column(3).type
            for b, ghost, i, t in zip(*(batch.column(c) for c in (0, 1, 3, 4)), strict=True):
                b, ghost, i, t = b.as_py(), ghost.as_py(), i.as_py(), t.as_py()
                if ghost and (waiting is None or waiting[0] != b):
                    continue  # a second row of the first id beyond
                own = digest(t.encode())
                if waiting is not None and waiting[0] == b:
                    _, wi, wt, wd = waiting
                    half = len(wt) // 2
                    edited = wt[: len(wt) - half] + t[:half]
                    ed = digest(edited.encode())
                    out.append((wi, len(wt), edited, wd, ed, likeness(wd, ed), likeness(wd, own)))
                    size += len(edited)
                waiting = None if ghost else (b, i, t, own)
                if size > BLOCK_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [arrow_id, *kinds], strict=True)], names=names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [arrow_id, *kinds], strict=True)], names=names)

    schema = f"id {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInArrow(run, schema)


def op3_quartile_digest(spark, sf_dir: str) -> DataFrame:
    """Each document's digest, that of its edited text, and how alike they and the next one's are."""
    out = fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
