"""Count-based hopping windows over a keyed, ordered table.

Sources are cut into chunks, each with the rows before it that its first
windows reach back to, so one long source spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import chunked
from .ranges import numbered as ranged_numbers


def geometry(fps: float, seconds: float) -> tuple[int, int]:
    """Rows of a window and of a hop."""
    rows = max(2, round(fps * seconds))
    return rows, max(1, rows // 4)


def ordered(*keys_and_order: str):
    """The window of the first name, or of the first and its ``part``, in the order of the others."""
    key, *order = keys_and_order
    return Window.partitionBy(key, "part").orderBy(*order[1:]) if order[0] == "part" else Window.partitionBy(key).orderBy(*order)


def _chunks(df: DataFrame, key: str, order: list[str], rows: int) -> DataFrame:
    return chunked(df, key, order, rows - 1)


def numbered(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("i", F.row_number().over(ordered(key, *order)))


def emitted(df: DataFrame, rows: int, step: int) -> DataFrame:
    """Keeps the row that ends each full window and numbers the windows; ``i`` counts rows from 1."""
    return df.where((F.col("i") >= rows) & ((F.col("i") - rows) % step == 0)).withColumn("window_idx", ((F.col("i") - rows) / step).cast("long"))


def hop_means(df: DataFrame, key: str, order: list[str], values: list[str], fps: float = 12.0, seconds: float = 1.0, pairs: bool = False) -> DataFrame:
    """Means of each window (W1, A1, P5); nulls are skipped and an empty mean is 0. ``pairs``: the values belong to a row and the one before, so a window has one fewer."""
    rows, step = geometry(fps, seconds)
    w = ordered(key, "part", "i").rowsBetween(-(rows - (2 if pairs else 1)), 0)
    out = _chunks(df, key, order, rows).select("*", *[F.coalesce(F.avg(v).over(w), F.lit(0.0)).alias(f"mean_{v}") for v in values])
    start = F.col("window_idx") * step / fps
    return emitted(out.where("own"), rows, step).select(key, "window_idx", start.alias("start_seconds"), (start + seconds).alias("end_seconds"), *[f"mean_{v}" for v in values])


def centre_rows(df: DataFrame, key: str, order: list[str], value: str, fps: float = 12.0, seconds: float = 1.0) -> DataFrame:
    """The middle value of each window."""
    rows, step = geometry(fps, seconds)
    out = _chunks(df, key, order, rows).withColumn("centre", F.lag(value, rows - 1 - rows // 2).over(ordered(key, "part", "i")))
    return emitted(out.where("own"), rows, step).select(key, "window_idx", "centre")


def dominant(df: DataFrame, key: str, order: list[str], label: str, score: str, default: str, fps: float = 12.0, seconds: float = 1.0) -> DataFrame:
    """Label with the largest positive score of each window, the first of equals (A2); null scores don't count.

    A window of ``rows`` rows covers the end of one block of as many rows and
    the beginning of the next, so its best is the better of two running bests:
    each row is looked at twice however long a window is.
    """
    rows, step = geometry(fps, seconds)
    best = F.struct(-F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))), F.col("i").alias("i"), F.col(label).alias("label"))
    t = _chunks(df, key, order, rows).select("*", F.floor((F.col("i") - 1) / rows).alias("block"), best.alias("best"))
    block = Window.partitionBy(key, "part", "block").orderBy("i")
    t = t.select("*", F.min("best").over(block.rowsBetween(Window.unboundedPreceding, 0)).alias("head"), F.min("best").over(block.rowsBetween(0, Window.unboundedFollowing)).alias("tail"))
    t = t.select("*", F.least("head", F.lag("tail", rows - 1).over(ordered(key, "part", "i"))).alias("top"))
    out = t.where("own").withColumn("dominant", F.when(F.col("top.col1") < 0, F.col("top.label")).otherwise(default))
    return emitted(out, rows, step).select(key, "window_idx", "dominant")


def auto_threshold(df: DataFrame, key: str, score: str) -> DataFrame:
    """Threshold of each key from a low order statistic of its scores (A3): element ``floor(n / 10)`` from 0, at most 1.2, then a clamped line.

    The statistic is found by its rank, which is counted over sorted ranges of
    source and score; so neither a long source nor one with few distinct scores
    is sorted in one task.
    """
    ranked = ranged_numbers(df.where(F.col(score).isNotNull()).select(key, score), key, [score])
    low = ranked.where(F.col("i") == F.floor(F.col("n") * 10 / 100) + 1).select(key, F.least(F.col(score), F.lit(1.2)).alias("b"))
    base = df.select(key).distinct().join(low, key, "left").select(key, F.coalesce("b", F.lit(0.5)).alias("baseline"))
    return base.select(key, "baseline", F.least(F.greatest(1.5 * F.col("baseline") + 0.5, F.lit(1.0)), F.lit(6.0)).alias("threshold"))
