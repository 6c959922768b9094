"""Layout of selected segments on one output timeline."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the folder that the session names; a folder is made up only on a local master without one."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def layout(items: DataFrame, key: str, timebase: int = 25, keep: tuple | list = ()) -> DataFrame:
    """Trimmed items with their place on the sequence.

    ``items(key, start_seconds, end_seconds, start_frame, end_frame, frames)``.
    Items are cut into ranges of their order; each range counts and sums its
    own, and starts at the sums of the ranges before it. The columns of ``keep``
    are handed on.
    """
    length = F.round(F.greatest(F.col("end_seconds") - F.col("start_seconds"), F.lit(0.0)) * timebase).cast("long")
    start = F.least("start_frame", "frames")
    end = F.greatest(F.least("end_frame", "frames"), start + 1)
    valid = items.withColumn("dur", length).where((F.col("start_frame") < F.col("frames")) & (F.col("end_frame") > F.col("start_frame")) & (F.col("dur") > 0))
    order = [key, "start_seconds", "end_seconds", "start_frame"]
    ranges = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = valid.select(*order, *[c for c in keep if c not in order], "dur", start.alias("in_frame"), end.alias("out_frame")).repartitionByRange(ranges, *order).withColumn("pid", F.spark_partition_id())
    ranged = durable(ranged)
    line, own = Window.partitionBy("pid").orderBy(*order), Window.partitionBy("pid", key).orderBy(*order)
    placed = ranged.select(
        "*", F.row_number().over(line).alias("i"), F.sum("dur").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("at"),
        F.dense_rank().over(Window.partitionBy("pid").orderBy(key)).alias("f"), F.row_number().over(own).alias("k"),
    )
    place = F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("key"))
    sums = placed.groupBy("pid").agg(F.count("*").alias("n"), F.sum("dur").alias("d"), F.max("f").alias("fs"), F.min(place).alias("lo"), F.max(place).alias("hi"))  # a row for each range
    each = Window.orderBy("pid")
    goes_on = F.lag("hi").over(each).isNotNull() & F.col("lo.key").eqNullSafe(F.lag("hi.key").over(each))
    before, zero = each.rowsBetween(Window.unboundedPreceding, -1), F.lit(0).cast("long")
    sums = sums.withColumn("goes_on", goes_on)
    sums = sums.select(
        "pid", "goes_on", F.coalesce(F.sum("n").over(before), zero).alias("n0"), F.coalesce(F.sum("d").over(before), zero).alias("d0"),
        (F.coalesce(F.sum("fs").over(before), zero) - F.sum(F.col("goes_on").cast("long")).over(each.rowsBetween(Window.unboundedPreceding, 0))).alias("f0"),
    )
    out = placed.join(F.broadcast(sums), "pid")
    end_at, first = F.col("d0") + F.col("at"), (F.col("k") == 1) & ~(F.col("goes_on") & (F.col("f") == 1))
    return out.select(key, *[c for c in keep if c != key], (F.col("n0") + F.col("i")).alias("item_idx"), (F.col("f0") + F.col("f")).alias("file_idx"), first.alias("full_record"), "in_frame", "out_frame", (end_at - F.col("dur")).alias("seq_start"), end_at.alias("seq_end"))


def sequence_seed(clips: DataFrame, key: str) -> DataFrame:
    """The clip whose format the sequence takes: timebase up to 60, then slow motion, then the lowest timebase, then the key."""
    rank = F.struct((F.col("timebase") > 60).cast("int"), (~F.col("slow_motion")).cast("int"), "timebase", key)
    return clips.agg(F.min_by(F.struct(key, "timebase", "slow_motion"), rank).alias("s")).where("s is not null").select(f"s.{key}", "s.timebase", "s.slow_motion")
