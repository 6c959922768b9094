"""Sources cut into ranges: row numbers, chunks with a halo, and running values over sources of any length.

A source may have most of all rows. Rows are cut into ranges of source and
order and sorted there; what a range needs of the ranges before it is one row
for each range and source in it, so no task reads a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .layout import durable

#: Rows of a chunk of a source.
CHUNK = 4_096


def ranged(df: DataFrame, key: str, order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` in sorted ranges, with the number of the range as ``__range``; one row is in one range however often it is read."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(ranges, key, *order).sortWithinPartitions(key, *order)
    return durable(cut.withColumn("__range", F.spark_partition_id()))


def numbered(df: DataFrame, key: str, order: list[str], ranges: int | None = None) -> DataFrame:
    """Adds ``i``, the number of a row in its source from 1, and ``n``, the rows of the source.

    Rows alike in all of ``order`` are numbered in any order, and may lie in
    several ranges.
    """
    cut = ranged(df.withColumn("__tie", F.monotonically_increasing_id()), key, [*order, "__tie"], ranges)
    heads = cut.groupBy("__range", F.col(key).alias("__key")).agg(F.count("*").alias("__own"))
    each = Window.partitionBy("__key").orderBy("__range")
    before = F.coalesce(F.sum("__own").over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select(F.col("__range").alias("__at"), "__key", before.alias("__before"), F.sum("__own").over(Window.partitionBy("__key")).alias("n"))
    inside = F.row_number().over(Window.partitionBy("__range", key).orderBy(*order, "__tie"))
    placed = cut.withColumn("__in", inside).join(heads, (F.col("__range") == F.col("__at")) & F.col(key).eqNullSafe(F.col("__key")))
    return placed.withColumn("i", F.col("__in") + F.col("__before")).drop("__tie", "__range", "__at", "__key", "__before", "__in")


def chunked(df: DataFrame, key: str, order: list[str], halo: int, chunk: int = CHUNK, ranges: int | None = None) -> DataFrame:
    """``numbered`` rows with ``part``, the chunk of ``chunk`` rows of a source; the last ``halo`` of a chunk also go to the next, where ``own`` is false."""
    chunk = max(chunk, halo)
    part = F.floor((F.col("i") - 1) / chunk)
    last = (F.col("i") - 1) % chunk >= chunk - halo
    home, visit = F.struct(part.alias("part"), F.lit(True).alias("own")), F.struct((part + 1).alias("part"), F.lit(False).alias("own"))
    return numbered(df, key, order, ranges).select("*", F.explode(F.when(last, F.array(home, visit)).otherwise(F.array(home))).alias("__c")).select("*", "__c.*").drop("__c")


def islands(df: DataFrame, key: str, start: str, end: str, tie: str, ranges: int | None = None) -> DataFrame:
    """Adds ``island``: the number, from 1, of the union of touching intervals that a row belongs to.

    A range's summary is its largest end; a row begins an island if it starts
    after the ends of all rows before it, in its own range and those before.
    """
    order = [start, end, tie]
    cut = ranged(df, key, order, ranges)
    each, inside = Window.partitionBy("__k").orderBy("__at"), Window.partitionBy("__range", key).orderBy(*order)
    earlier = each.rowsBetween(Window.unboundedPreceding, -1)
    here = (F.col("__range") == F.col("__at")) & F.col(key).eqNullSafe(F.col("__k"))
    tops = cut.groupBy(F.col("__range").alias("__at"), F.col(key).alias("__k")).agg(F.max(end).alias("__end")).select("__at", "__k", F.max("__end").over(earlier).alias("__up"))
    seen = cut.join(tops, here).drop("__at", "__k")
    top = F.greatest(F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("__up"))  # nulls don't count
    seen = durable(seen.withColumn("__new", F.when(top.isNull() | (F.col(start) > top), 1).otherwise(0).cast("long")))
    counts = seen.groupBy(F.col("__range").alias("__at"), F.col(key).alias("__k")).agg(F.sum("__new").alias("__n")).select("__at", "__k", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    number = F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return seen.withColumn("__number", number).join(counts, here).withColumn("island", F.col("__number") + F.col("__before")).drop("__number", "__before", "__at", "__k", "__new", "__up", "__range")
