"""Filter interaction audit: which filters fail a document, and what each would remove in any order.

Rows are cut into ranges and sorted by a fingerprint of the text, the full text
and the id. A task compares each row with the one before it: a row whose text is
the one before's, under a larger id, is a duplicate. What a task can't know is
whether its first texts began in the range before; those rows stay open until
the least ids of the texts at the ends of the ranges, a few rows for each, have
been put together. Failure masks are then summed into counters that add up:
documents, good and toxic ones for each part and mask. All orders of the
filters follow from these 32 counters of a part.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

#: The filters in the order of their bits, and the one that only the sorted order can answer.
FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Rows that a task hands on at once.
ROWS = 20_000
_UPPER, _SYMBOLS = bytes(range(65, 91)), b"#$%&*|"


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails: few words, few distinct words, many capitals, symbols."""
    words = text.split()
    few = len(words) < 100
    alike = 100 * len(set(words)) < 80 * len(words)
    capitals = 100 * (len(text) - len(text.translate(None, _UPPER))) > 10 * (len(text) if text.isascii() else len(text.decode()))
    return few | alike << 1 | capitals << 2 | (len(text.translate(None, _SYMBOLS)) != len(text)) << 3


def _compared(batches):
    """Rows ``(id, part, mask, text, least, edge)`` of sorted ``(f, text, id, part)``: each row set against the one before.

    ``edge`` is 0 for a settled row; 1 for one with the least id here of a text
    under the range's first fingerprint, which is a duplicate only if the text
    began in a range before; 2 for the least id of a text under the first or
    last fingerprint, no document's row. ``text`` is a digest, given where
    ``edge`` isn't 0.
    """
    names, out, kind = ["id", "part", "mask", "text", "least", "edge"], [], None
    first = now = last = least = digest = None
    mask, ends = 0, []  # ends: the texts under the present fingerprint, with their least ids

    def flushed():
        kinds = [kind, pa.string(), pa.int32(), pa.binary(), kind, pa.int32()]
        done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out.clear()
        return done

    def closed():
        return [(None, None, 0, hashlib.sha256(t).digest(), i, 2) for t, i in ends if i is not None]

    for b in batches:
        kind = b.column(2).type
        for f, t, i, part in zip(b.column(0).to_numpy().tolist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            text = t.as_buffer().to_pybytes()
            if f != now:
                if now == first and now is not None:
                    out += closed()
                now, ends, last = f, [], None
                first = f if first is None else first
            if text != last:
                last, least, mask = text, None, text_mask(text)
                digest = hashlib.sha256(text).digest() if now == first else None
                ends.append([text, None])
            if i is None:
                out.append((i, part, mask, None, None, 0))
            elif least is None or i == least:
                least = ends[-1][1] = i
                out.append((i, part, mask, digest, i, 1) if now == first else (i, part, mask, None, None, 0))
            else:
                out.append((i, part, mask | DUPLICATE, None, None, 0))
            if len(out) >= ROWS:
                yield flushed()
    out += closed()
    if out:
        yield flushed()


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(id, part, mask)`` for each row; bit ``k`` of the mask is set if the filter ``FILTERS[k]`` fails.

    A null text is an empty one, a null part the empty string. A row is a
    duplicate if a smaller id has the same text; so rows of one id never make
    each other duplicates, and a row without an id neither is one nor makes
    one. Repeated rows each keep their row and spread over the ranges; an
    empty table gives an empty result; texts are whole, and only the two
    fingerprints at a range's ends keep a digest; other columns may have any
    names. Texts of one fingerprint are told apart by their bytes, across
    ranges by SHA-256.
    """
    text, kind = F.coalesce(F.col(text_col), F.lit("")), docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.xxhash64(text).alias("f"), text.cast("binary").alias("text"), F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.monotonically_increasing_id().alias("row"))
    ids = F.col("id").asc_nulls_first()
    ranged = rows.repartitionByRange(partitions(docs), "f", ids, "row").sortWithinPartitions("f", "text", ids).select("f", "text", "id", "part")
    seen = stored(ranged.mapInArrow(_compared, f"id {kind}, part string, mask int, text binary, least {kind}, edge int"))
    began = seen.where("edge = 2").groupBy("text").agg(F.min("least").alias("began"))  # the texts at the ends of ranges: two or so for each
    late = F.col("began") < F.col("least")
    return seen.where("edge < 2").join(F.broadcast(began), "text", "left").select("id", "part", F.when(late, F.col("mask").bitwiseOR(DUPLICATE)).otherwise(F.col("mask")).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(part, n, good, toxic)``: for each part an array each, with a count for each mask.

    A document is good if any of its labels has quality 1, toxic if any has
    toxic 1. Labels are joined to masks, not to texts; those without a document
    count nowhere.
    """
    flag = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("long")).alias(c)
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(flag("quality"), flag("toxic"))
    none = F.lit(0).cast("long")
    every = masks.groupBy("part", "mask").agg(F.count("*").alias("n")).withColumns({"good": none, "bad": none})
    known = masks.join(marks, "id").groupBy("part", "mask").agg(F.sum("quality").alias("good"), F.sum("toxic").alias("bad")).withColumn("n", none)
    sums = every.unionByName(known).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")])
    whole = lambda c: F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(none)) for m in range(1 << len(FILTERS))])
    return sums.groupBy("part").agg(whole("n").alias("n"), whole("good").alias("good"), whole("bad").alias("toxic"))


def _total(counts: str, *conditions) -> Column:
    """Sum of the counts of the masks that meet all conditions."""

    def step(acc, m):
        meets = conditions[0](m)
        for c in conditions[1:]:
            meets = meets & c(m)
        return acc + F.when(meets, F.get(counts, m)).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1)), F.lit(0).cast("long"), step)


def order_report(counts: DataFrame) -> DataFrame:
    """``mask_counts`` to a row for each part, order of the filters and step in it.

    A filter's Shapley sum is taken over all orders: it removes a document of a
    mask in those orders in which it comes before the mask's other filters, an
    equal share of all.
    """
    orders = ["".join(p) for p in permutations(FILTERS)]
    t = counts.select("*", F.explode(F.split(F.lit(",".join(orders)), ",")).alias("filter_order"))
    t = t.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda letter: F.pow(F.lit(2), F.instr(F.lit(FILTERS), letter) - 1).cast("int")
    own = bit(F.substring("filter_order", F.col("step"), F.lit(1)))
    before = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda acc, s: acc + F.when(s < F.col("step"), bit(F.substring("filter_order", s, F.lit(1)))).otherwise(0))
    t = t.withColumns({"own": own, "before": before})
    fails, passed, went = (lambda m: m.bitwiseAND(F.col("own")) != 0), (lambda m: m.bitwiseAND(F.col("before")) == 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)
    share = F.aggregate(F.sequence(F.lit(1), F.lit((1 << len(FILTERS)) - 1)), F.lit(0).cast("long"), lambda acc, m: acc + F.when(fails(m), F.get("n", m) * F.floor(len(orders) / F.bit_count(m))).otherwise(0))
    return t.select(
        "part", "filter_order", "step", _total("n", passed, lambda m: ~fails(m)).alias("kept"), _total("n", passed, fails).alias("removed"), _total("n", went, fails).alias("redundant"),
        F.get("n", F.col("own")).alias("unique_fails"), _total("good", passed, fails).alias("good_lost"), _total("toxic", passed, fails).alias("toxic_lost"), share.alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """What each filter removes of each language in all orders of the five."""
    masks = failure_masks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return order_report(mask_counts(masks, spark.read.parquet(f"{sf_dir}/labels.parquet")))
