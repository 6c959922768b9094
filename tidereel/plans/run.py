"""A whole run: pair scores to windows, kinds, segments, runs, selects, the result store and the timeline.

Sources whose stored rows fit path, size, time and settings are reused; only
the others are analysed. Selection runs once before rows are stored and once
more over all before layout, for fresh and stored rows alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidereel.functions import media, motion
from tidereel.operators import folds, layout, selection, windows
from tidereel.sources import catalog, frame_files, frames, store

from .progress import Progress
from .settings import Settings

c = F.col
SEGMENT = ["source_path", "pos", "start_seconds", "end_seconds", "start_frame", "end_frame", "kind", "motion", "zoom", "movement", "confidence", "person", "windows"]


def type_score() -> Column:
    """P25: the score that speaks for a pair's movement type."""
    return F.when(c("movement") == "Zoom", c("zoom")).when(c("movement") == "Roll", c("rotation")).when(c("movement") == "Complex", F.greatest("shear", "rotation")).otherwise(c("motion"))


def window_scores(pairs: DataFrame, settings: Settings, people: DataFrame | None = None) -> DataFrame:
    """``pairs(source_path, frame_idx, motion, zoom, rotation, shear, confidence, movement)`` to one row for each window.

    W1, W2, A1, A2, P3, P5: each frame but the first, which is frame 0, has a
    row; null scores are skipped, a window without any is all zero. Windows go
    by the frames' numbers, so a frame that is left out moves no later window.
    Scores but the confidence are scaled to a rate of six frames a second. ``people(source_path, frame_idx,
    person)`` has the detector's scores of centre frames (W3); without it the
    person is null (V7).
    """
    rows, step = windows.geometry(settings.fps, settings.window_seconds)
    line = Window.partitionBy("source_path").orderBy("frame_idx")
    ring = line.rangeBetween(-(rows - 2), 0)
    rate = settings.fps / motion.BASE_FPS
    mean = lambda x: F.coalesce(F.avg(x).over(ring), F.lit(0.0))
    best = F.min_by("movement", F.when(c("speaks").isNotNull(), F.struct(-c("speaks"), "frame_idx"))).over(ring)
    t = pairs.withColumn("speaks", type_score()).withColumn("i", F.col("frame_idx") + 1)
    t = t.select(
        "source_path", "i", "frame_idx", *[(mean(x) * rate).alias(x) for x in ("motion", "zoom", "rotation", "shear")], mean("confidence").alias("confidence"),
        F.when(F.max("speaks").over(ring) > 0, best).otherwise("PanTilt").alias("movement"),
    )
    t = windows.emitted(t, rows, step)
    start = c("window_idx") * step / settings.fps
    t = t.withColumns({"start_seconds": start, "end_seconds": start + settings.window_seconds, "centre": c("frame_idx") - (rows - 1 - rows // 2)})
    if people is None or not settings.detector:
        return t.drop("i", "frame_idx", "centre").withColumn("person", F.lit(None).cast("double"))
    seen = people.groupBy("source_path", c("frame_idx").alias("centre")).agg(F.max("person").alias("person"))
    return t.drop("i", "frame_idx").join(seen, ["source_path", "centre"], "left").drop("centre")


def window_segments(scored: DataFrame, sources: DataFrame, settings: Settings) -> DataFrame:
    """A segment for each window that has a kind; only subjects carry a person."""
    if settings.motion_threshold > 0:
        t = scored.withColumn("threshold", F.lit(settings.motion_threshold))
    else:
        t = scored.join(windows.auto_threshold(scored, "source_path", "motion").select("source_path", "threshold"), "source_path")
    known = sources.select("source_path", "timebase", c("slow_motion").alias("slow"), c("duration_seconds").alias("length"))
    t = folds.classify(t.join(known, "source_path"), "source_path", "window_idx", settings.person_threshold).where("kind is not null")
    subject = c("kind").isin(folds.SUBJECT, folds.STATIC)
    return t.select(
        "source_path", c("window_idx").alias("pos"), "start_seconds", "end_seconds",
        media.seconds_to_frame(c("start_seconds"), c("timebase")).alias("start_frame"), media.seconds_to_frame(c("end_seconds"), c("timebase")).alias("end_frame"),
        "kind", "motion", "zoom", F.when(subject, "Subject").when(c("kind") == folds.SLOW, "SlowMotion").otherwise(c("movement")).alias("movement"),
        "confidence", F.when(subject, c("person")).alias("person"), F.lit(1).cast("long").alias("windows"), "length",
    )


def selects(segments: DataFrame, sources: DataFrame) -> DataFrame:
    """The selects of each source; a source without any gives its whole length."""
    length = sources.select("source_path", c("duration_seconds").alias("length"))
    chosen = selection.select(segments.drop("length").join(length, "source_path"), "source_path").select(*SEGMENT)
    bare = sources.join(chosen.select("source_path").distinct(), "source_path", "left_anti")
    whole = bare.select(
        "source_path", F.lit(0).cast("long").alias("pos"), F.lit(0.0).alias("start_seconds"), c("duration_seconds").alias("end_seconds"), F.lit(0).cast("long").alias("start_frame"),
        c("duration_frames").alias("end_frame"), F.lit(folds.STATIC).alias("kind"), F.lit(0.0).alias("motion"), F.lit(0.0).alias("zoom"), F.lit("Subject").alias("movement"),
        F.lit(1.0).alias("confidence"), F.lit(None).cast("double").alias("person"), F.lit(1).cast("long").alias("windows"),
    )
    return chosen.unionByName(whole)


def analyse(pairs: DataFrame, sources: DataFrame, settings: Settings, people: DataFrame | None = None) -> DataFrame:
    """Selects of each source, as they are stored."""
    segments = window_segments(window_scores(pairs, settings, people), sources, settings)
    return selects(folds.merge_runs(segments, "source_path"), sources)


#: What is stored of a source's probe, so that a timeline can be made from the store alone.
PROBED = ["width", "height", "duration_seconds", "duration_frames", "timebase", "ntsc", "slow_motion"]


def resume(pairs: DataFrame | Callable[[DataFrame], DataFrame], sources: DataFrame, settings: Settings, path: str, people: DataFrame | None = None, progress: Progress | None = None, slices: int = 1) -> tuple[DataFrame, DataFrame]:
    """Analyses what the store lacks, stores it, and gives all selects and one row of counts.

    ``sources(source_path, mtime, size, width, height, duration_seconds,
    duration_frames, timebase, ntsc, slow_motion[, error])``; rows with an
    error count as failed and are left out. ``pairs`` may be a function that
    gives the pair scores of the sources that are left to analyse. ``slices``:
    how many commits the analysis is cut into, by a hash of the path; a run
    that ends early keeps those that are done.
    """
    spark, marks, mark = sources.sparkSession, ["source_path", "size", "mtime", "fingerprint"], settings.fingerprint
    progress = progress or Progress(spark)
    sources = sources.withColumn("fingerprint", F.lit(mark))
    good = sources.where(c("error").isNull()) if "error" in sources.columns else sources
    stored = store.load_or_empty(spark, path, good.select(*marks).schema, mark)
    hit, miss = store.split_work(good, stored, marks)

    def scores(part: DataFrame) -> DataFrame:
        return pairs(part) if callable(pairs) else pairs.join(part.select("source_path"), "source_path", "left_semi")

    def analysed(scored: DataFrame, part: DataFrame) -> DataFrame:
        return analyse(scored, part, settings, people).join(part.select(*marks, *PROBED), "source_path")

    with progress.phase("analyse") as counts:
        counts.update(slices=0, segments=0)
        for k in range(slices):
            part = miss.where(F.pmod(F.xxhash64("source_path"), F.lit(slices)) == k) if slices > 1 else miss
            scored = scores(part)
            if part.isEmpty():  # each source has a row at least; a slice without any adds no batch
                continue
            with progress.phase(f"slice {k + 1} of {slices}") as own:
                seen = Observation()
                store.append(analysed(scored, part).observe(seen, F.count("*").alias("segments")), path, before=progress.check)
                own["segments"] = seen.get["segments"]
            counts.update(slices=counts["slices"] + 1, segments=counts["segments"] + own["segments"])
    kept = store.load(spark, path, fingerprint=mark) if store.exists(spark, path, mark) else analysed(scores(miss), miss)
    chosen = selects(kept.join(good.select(*marks), marks, "left_semi").select(*SEGMENT), good)
    progress.outcomes(outcomes(sources, hit, chosen))
    counts = chosen.agg(F.count("*").alias("exported"))
    tally = sources.agg(F.count("*").alias("scanned")).crossJoin(good.agg(F.count("*").alias("analysed"))).crossJoin(hit.agg(F.count("*").alias("reused"))).crossJoin(counts)  # one row each
    return chosen, tally.select("scanned", "analysed", "reused", (c("scanned") - c("analysed")).alias("failed"), "exported")


def outcomes(sources: DataFrame, hit: DataFrame, chosen: DataFrame) -> DataFrame:
    """Of each source whether it succeeded, its error, its number of segments and whether they were in the store before (K9)."""
    error = c("error") if "error" in sources.columns else F.lit(None)
    known = sources.select("source_path", error.cast("string").alias("error"))
    parts = chosen.groupBy("source_path").agg(F.count("*").alias("segments"))
    t = known.join(parts, "source_path", "left").join(hit.select("source_path", F.lit(True).alias("held")), "source_path", "left")
    return t.select("source_path", c("error").isNull().alias("ok"), "error", F.coalesce("segments", F.lit(0).cast("long")).alias("segments"), F.coalesce("held", F.lit(False)).alias("from_store"))


def sequence_format(chosen: DataFrame, sources: DataFrame) -> tuple[int, bool, int, int]:
    """Timebase, drop rate, width and height of the sequence; without any clip 25 frames a second and 1920 x 1080."""
    clips = sources.join(chosen.select("source_path").distinct(), "source_path", "left_semi")
    seed = layout.sequence_seed(clips, "source_path").first()
    if seed is None:
        return 25, False, 1920, 1080
    own = sources.where(c("source_path") == seed.source_path).select("timebase", "ntsc", "width", "height").first()
    return own.timebase, bool(own.ntsc), own.width, own.height


def timeline(chosen: DataFrame, sources: DataFrame, timebase: int | None = None) -> DataFrame:
    """Clip items in the sequence's frame rate, with what the XML needs of their sources."""
    known = sources.select("source_path", c("duration_frames").alias("frames"), c("timebase"), "ntsc", "width", "height", "slow_motion")
    timebase = timebase or sequence_format(chosen, sources)[0]
    own = chosen.join(known, "source_path").where(F.round(F.greatest(c("end_seconds") - c("start_seconds"), F.lit(0.0)) * c("timebase")) > 0)
    return layout.layout(own, "source_path", timebase, keep=["start_seconds", "end_seconds", "kind", "movement", "frames", "timebase", "ntsc", "width", "height"])


def export(chosen: DataFrame, sources: DataFrame, path: str, name: str = "Timeline") -> None:
    """K1: the selects as an XML timeline below ``path``, always anew."""
    base, ntsc, *_ = sequence_format(chosen, sources)
    store.write_timeline_xml(store.described(timeline(chosen, sources, base)), path, base, ntsc, name)


#: The summary of a run without any file.
NOTHING = {"scanned": 0, "analysed": 0, "reused": 0, "failed": 0, "exported": 0}


def run_folder(
    spark: SparkSession, folder: str, extensions: str, settings: Settings, stored: str, xml: str, pairs: Callable[[DataFrame], DataFrame], prober=catalog.PROBER, progress: Progress | None = None, slices: int = 1
) -> dict:
    """From a folder of files to the XML: catalog, probe, analysis of what the store lacks, selection, layout, export.

    ``pairs`` gives the pair scores of sources; see ``packed_pairs``. Gives the
    summary (K10). No file at all leaves no XML; where all files fail it has no
    clip. A file that fails is counted and doesn't end the run. ``progress``
    keeps the events of the run and can cancel it; see ``resume`` for ``slices``.
    """
    progress = progress or Progress(spark)
    with progress.phase("scan") as counts:
        seen = Observation()
        sources = layout.durable(catalog.sources(spark, folder, extensions, prober).observe(seen, F.count("*").alias("scanned"), F.count("error").alias("failed")))
        counts.update(seen.get)
    if not counts["scanned"]:
        return dict(NOTHING)
    chosen, tally = resume(pairs, sources, settings, stored, None, progress, slices)
    with progress.phase("export") as counts:
        export(chosen, sources.where(c("error").isNull()), xml)
        counts.update(tally.first().asDict())
    return dict(counts)


def packed_pairs(settings: Settings, **options) -> Callable[[DataFrame], DataFrame]:
    """Pair scores of packed frame files, scaled and resampled as the settings say; only the files that are asked for are opened."""

    def of(sources: DataFrame) -> DataFrame:
        paths = [r.source_path for r in sources.select("source_path").toLocalIterator()]  # the plan of the source needs the names
        spark = sources.sparkSession
        if not paths:
            return spark.createDataFrame([], frames.PAIRS)
        return frames.pair_scores(frame_files.read_frames(spark, *paths, height=settings.height, fps=settings.fps, **options))

    return of


def recover(spark: SparkSession, stored: str, xml: str) -> dict:
    """The timeline of all stored rows, without files, settings or stat: what was stored last of each source.

    An empty store gives an empty summary and no XML.
    """
    rows = layout.durable(store.load(spark, stored, any_settings=True)) if store.exists(spark, stored) else None
    if rows is None or rows.isEmpty():
        return dict(NOTHING)
    sources = rows.groupBy("source_path").agg(*[F.first(x).alias(x) for x in PROBED])
    chosen = selects(rows.select(*SEGMENT), sources)
    export(chosen, sources, xml)
    n = sources.count()
    return {**NOTHING, "scanned": n, "analysed": n, "reused": n, "exported": chosen.count()}
