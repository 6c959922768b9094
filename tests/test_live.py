"""Live frame streams against the batch run of the same frames."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sources import scene
from tidereel.operators import folds
from tidereel.plans import run
from tidereel.plans.settings import Settings
from tidereel.sources import frames
from tidereel.streaming import live

SCHEMA = "source_path string, frame_idx long, width int, height int, pixels binary"
SETTINGS = Settings(fps=6.0, window_seconds=1.0, motion_threshold=1.8)
COLUMNS = ["source_path", "window_idx", "start_seconds", "end_seconds", "motion", "zoom", "rotation", "shear", "confidence", "movement", "kind"]


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def clips():
    """Two sources; one rests, moves and rests, and has a broken and a missing frame."""
    rng, at, rows = np.random.default_rng(5), 0, []
    for k in range(40):
        at += 0 if k < 10 or k > 28 else int(rng.integers(1, 5))
        px = np.repeat(scene(dx=at)[..., None], 3, 2).tobytes()
        if k != 17:
            rows.append(("a", k, 96, 64, bytearray(b"short" if k == 23 else px)))
    rows += [("b", k, 96, 64, bytearray(scene(dx=3 * k).tobytes())) for k in range(15)]
    return rows


def write(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def expected(spark, rows):
    scored = run.window_scores(frames.pair_scores(spark.createDataFrame(rows, SCHEMA)), SETTINGS)
    kinds = folds.classify(scored.withColumn("threshold", F.lit(SETTINGS.motion_threshold)).withColumn("slow", F.lit(False)), "source_path", "window_idx")
    return sorted(map(tuple, kinds.select(*COLUMNS).collect()))


def start(spark, folder, out, idle=600.0, patience=64):
    found = live.live_windows(spark.readStream.schema(SCHEMA).parquet(folder), SETTINGS, idle, patience)
    return found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")


def drain(query, rows, done=lambda: True):
    """Lets the query run until it has taken ``rows`` frames and ``done`` says so, then stops it."""
    until = time.time() + 60
    try:
        while time.time() < until and query.isActive and not (sum(p.numInputRows for p in query.recentProgress) >= rows and done()):
            time.sleep(0.3)
        assert query.isActive and time.time() < until
    finally:
        query.stop()


def got(spark, out, event="window"):
    return spark.read.schema(live.OUT).parquet(f"{out}/rows").where(F.col("event") == event)


@pytest.mark.parametrize("cuts", [[7, 8, 30], [1, 21]])
def test_any_cut_gives_the_rows_of_the_batch_run_also_after_a_restart(spark, rocks, tmp_path, cuts):
    rows = sorted(clips(), key=lambda r: (r[1], r[0]))
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        write(spark, rows[lo:hi], f"{tmp_path}/in")
        # each part is a query of its own, which goes on from the checkpoint
        drain(start(spark, f"{tmp_path}/in", tmp_path).trigger(processingTime="1 second").start(), hi - lo)
    # patience holds back what follows the missing frame of a: the end hands it on
    done = {tuple(r) for r in got(spark, tmp_path).select(*COLUMNS).collect()}
    whole = expected(spark, rows)
    assert {r[0] for r in whole} == {"a", "b"} and len({r[-1] for r in whole}) > 1
    assert done == {r for r in whole if r[0] == "b" or r[1] + 5 < 17}  # a window is six frames


def test_frames_out_of_order_and_the_end_of_a_source(spark, rocks, tmp_path):
    rows = clips()
    rng = np.random.default_rng(3)
    mixed = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 9))
    write(spark, mixed[:25] + mixed[10:12], f"{tmp_path}/in")
    query = start(spark, f"{tmp_path}/in", tmp_path, idle=8.0, patience=12).trigger(processingTime="1 second").start()
    write(spark, mixed[25:], f"{tmp_path}/in")
    drain(query, len(mixed) + 2, lambda: got(spark, tmp_path, "end").count() == 2)
    assert sorted(map(tuple, got(spark, tmp_path).select(*COLUMNS).collect())) == expected(spark, rows)
    assert {(r.source_path, r.frame_idx, r.late) for r in got(spark, tmp_path, "end").collect()} == {("a", 39, 0), ("b", 14, 0)}


def test_settings_that_a_live_stream_cannot_have(spark):
    for bad in (Settings(motion_threshold=0.0), Settings(detector=True)):
        with pytest.raises(ValueError):
            live.live_windows(None, bad)
