"""Rule filters, trims and interval coalescing of segments: row predicates and window functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import MOVE, SLOW, STATIC, SUBJECT, movement_rank
from .ranges import islands

#: Seconds, scores and counts of the rules: fixed values.
EDGE, EDGE_LONGEST, JERK_LONGEST, TAIL_LONGEST, TAIL_START = 1.5, 3.2, 2.4, 3.2, 3.6
SPIKE_LONGEST, SPIKE_SHORT, SPIKE_MOTION, SPIKE_ZOOM = 1.75, 1.5, 3.8, 2.5
LOW_CONFIDENCE, EDGE_CONFIDENCE, STABLE, SINGLE_LEAST = 0.70, 0.80, 2, 1.25
SINGLE_MOTION, SINGLE_ZOOM, SINGLE_PERSON, SINGLE_SLOW_MOTION, SINGLE_SLOW_ZOOM = 3.1, 1.8, 0.72, 1.2, 0.8
HANDLE_FRAMES, KEEP_SECONDS, DEFAULT_FPS, TOUCH = 30.0, 1.0, 25.0, 0.01
JERK_PRONE = ("PanTilt", "Roll", "Complex")

c = F.col


def duration() -> Column:
    return F.greatest(c("end_seconds") - c("start_seconds"), F.lit(0.0))


def known_length(length: str = "length") -> Column:
    return c(length).isNotNull() & ~F.isnan(length) & (c(length) > 0) & (c(length) < F.lit(float("inf")))


def touches_edge() -> Column:
    """near the start or the end of a source of known length."""
    return known_length() & ((c("start_seconds") <= EDGE) | (c("length") - c("end_seconds") <= EDGE))


def energetic() -> Column:
    return (c("motion") >= SPIKE_MOTION) | (c("zoom") >= SPIKE_ZOOM)


def jerk() -> Column:
    """F1."""
    d = duration()
    unstable = (d <= JERK_LONGEST) & ((c("windows") <= 2) | (c("confidence") < LOW_CONFIDENCE))
    edge = touches_edge() & (d <= EDGE_LONGEST) & ((c("confidence") < EDGE_CONFIDENCE) | (c("windows") <= 3))
    snap = (d <= JERK_LONGEST) & energetic()
    return (c("kind") == MOVE) & ((d <= 0) | (c("movement").isin(*JERK_PRONE) & (unstable | edge | snap)))


def tail_jerk() -> Column:
    """F2."""
    return (c("kind") == MOVE) & known_length() & (duration() <= TAIL_LONGEST) & touches_edge() & (c("start_seconds") >= c("length") - TAIL_START)


def spike() -> Column:
    """F3; a null length touches no end."""
    d = duration()
    edge = (c("start_seconds") <= EDGE) | F.coalesce(c("length") - c("end_seconds") <= EDGE, F.lit(False))
    return (c("kind") != SLOW) & c("person").isNull() & (d <= SPIKE_LONGEST) & energetic() & (edge | (d <= SPIKE_SHORT))


def confident() -> Column:
    """F4, the rule that keeps."""
    single = (
        F.when(c("kind") == MOVE, (c("motion") >= SINGLE_MOTION) | (c("zoom") >= SINGLE_ZOOM))
        .when(c("kind").isin(SUBJECT, STATIC), F.coalesce("person", F.lit(0.0)) >= SINGLE_PERSON)
        .when(c("kind") == SLOW, (c("motion") >= SINGLE_SLOW_MOTION) | (c("zoom") >= SINGLE_SLOW_ZOOM))
        .otherwise(F.lit(False))
    )
    return (c("windows") >= STABLE) | ((duration() >= SINGLE_LEAST) & single)


def reject(segments: DataFrame) -> DataFrame:
    """F1 to F4 as one conjunction."""
    return segments.where(~jerk() & ~tail_jerk() & ~spike() & confident())


def _frame(old: str) -> Column:
    return F.when(c("__new").isNull(), c(old)).otherwise(F.greatest(F.round(c("__new") * c("__fps")), F.lit(0.0)).cast("long"))


def _clip(df: DataFrame, applies: Column, at_start: Column, start_to: Column, at_end: Column, end_to: Column) -> DataFrame:
    span = c("end_seconds") - c("start_seconds")
    fps = F.when(span > 0, (c("end_frame") - c("start_frame")) / span).otherwise(DEFAULT_FPS)
    df = df.withColumn("__fps", fps)
    new = F.least(start_to, c("end_seconds") - KEEP_SECONDS)
    df = df.withColumn("__new", F.when(applies & at_start & (new > c("start_seconds")), new))
    df = df.withColumns({"start_seconds": F.coalesce("__new", "start_seconds"), "start_frame": _frame("start_frame")})
    new = F.greatest(end_to, c("start_seconds") + KEEP_SECONDS)
    df = df.withColumn("__new", F.when(applies & (c("length") > 0) & at_end & (new < c("end_seconds")), new))
    df = df.withColumns({"end_seconds": F.coalesce("__new", "end_seconds"), "end_frame": _frame("end_frame")})
    return df.drop("__fps", "__new")


def transition_handles(segments: DataFrame) -> DataFrame:
    """Moves that touch an end of their source lose so many frames there, but keep a second."""
    room = HANDLE_FRAMES / c("__fps")
    return _clip(segments, c("kind") == MOVE, (c("start_frame") == 0) | (c("start_seconds") <= TOUCH), room, c("end_seconds") >= c("length") - TOUCH, c("length") - room)


def edge_noise(segments: DataFrame) -> DataFrame:
    """Moves without a person are cut back to a margin from both ends."""
    return _clip(segments, (c("kind") == MOVE) & c("person").isNull(), c("start_seconds") <= EDGE, F.lit(EDGE), c("end_seconds") >= c("length") - EDGE, c("length") - EDGE)


def coalesce_overlaps(segments: DataFrame, key: str) -> DataFrame:
    """Touching or overlapping segments of a source become one."""
    order = ["start_seconds", "end_seconds", "pos"]
    isles = islands(segments, key, *order)
    w = c("windows")
    kind = F.when(F.count("*") == 1, F.min("kind")).when(F.bool_or(c("kind") == SLOW), SLOW).when(F.bool_or(c("person").isNotNull()), SUBJECT).otherwise(MOVE)
    out = isles.groupBy(key, "island").agg(
        F.min("start_seconds").alias("start_seconds"), F.max("end_seconds").alias("end_seconds"), F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"),
        kind.alias("kind"), (F.sum(c("motion") * w) / F.sum(w)).alias("motion"), F.max("zoom").alias("zoom"), (F.sum(c("confidence") * w) / F.sum(w)).alias("confidence"),
        F.max("person").alias("person"), F.sum(w).alias("windows"), F.min("pos").alias("pos"), F.count("*").alias("n"), F.min_by("movement", F.struct(-movement_rank(), *order)).alias("__m"),
    )
    movement = F.when(c("n") == 1, c("__m")).when(c("kind") == SLOW, "SlowMotion").when(c("kind").isin(SUBJECT, STATIC), "Subject").otherwise(c("__m"))
    return out.withColumn("movement", movement).drop("__m")


def select(segments: DataFrame, key: str) -> DataFrame:
    """Trims, filters, then coalescing. ``segments`` carry their source's ``length``."""
    trimmed = edge_noise(transition_handles(segments))
    # a generator keeps the rules from being pushed below the trims, with these copied into every one of them
    trimmed = trimmed.select(F.explode(F.array(F.struct("*"))).alias("s")).select("s.*")
    kept = reject(trimmed)
    lengths = segments.select(key, "length").distinct()
    return coalesce_overlaps(kept, key).join(lengths, key)


def retain(sources: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """A source without any select gives one full-length static row; ``sources(key, length, frames)``."""
    bare = sources.join(selected.select(key).distinct(), key, "left_anti")
    whole = bare.select(key, F.lit(0.0).alias("start_seconds"), c("length").alias("end_seconds"), F.lit(0).cast("long").alias("start_frame"), c("frames").alias("end_frame"), F.lit(STATIC).alias("kind"))
    return selected.select(whole.columns).unionByName(whole)
