"""Snapshots of the store, events of a run, and cancelling."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tests.test_folder_run import clip, prober  # noqa: F401
from tidereel.plans import progress, run
from tidereel.plans.settings import Settings
from tidereel.sources import store
from tidereel.streaming import incremental

ROW = "source_path string, v long, fingerprint string"


def rows_of(df):
    return sorted(map(tuple, df.select("source_path", "v", "fingerprint").collect()))


def test_last_commit_of_a_source_wins_and_older_snapshots_stay(spark, tmp_path):
    path = f"{tmp_path}/s"
    assert not store.exists(spark, path) and store.snapshot(spark, path).number == 0
    store.append(spark.createDataFrame([("a", 1, "12"), ("a", 2, "12"), ("b", 3, "x/y=1")], ROW), path)
    reader = store.load(spark, path)  # planned before the next commits
    store.append(spark.createDataFrame([("a", 9, "12"), ("b", 4, "12")], ROW), path)
    store.append(spark.createDataFrame([], ROW), path)
    assert rows_of(store.load(spark, path)) == [("a", 9, "12"), ("b", 3, "x/y=1"), ("b", 4, "12")]
    assert rows_of(store.load(spark, path, any_settings=True)) == [("a", 9, "12"), ("b", 4, "12")]
    assert rows_of(store.load(spark, path, fingerprint="x/y=1")) == [("b", 3, "x/y=1")]
    first = [("a", 1, "12"), ("a", 2, "12"), ("b", 3, "x/y=1")]
    assert rows_of(reader) == rows_of(store.load(spark, path, number=1)) == first
    assert store.snapshots(spark, path) == [1, 2]


def test_small_batches_are_merged(spark, tmp_path):
    path, n = f"{tmp_path}/s", 25
    for k in range(n):
        store.append(spark.createDataFrame([(f"s{k % 7}", k, f"f{k % 2}"), (f"t{k}", k, "f0")], ROW).coalesce(1), path)
    whole, any_one = rows_of(store.load(spark, path)), rows_of(store.load(spark, path, any_settings=True))
    reader = store.load(spark, path)
    store.compact(spark, path)
    assert len(store.snapshot(spark, path).folders) == 1
    files = sum(f.endswith(".parquet") for f in os.listdir(f"{tmp_path}/s/data/folder={store.snapshot(spark, path).folders[0]['folder']}/fingerprint=f0"))
    assert files == 1
    assert (rows_of(store.load(spark, path)), rows_of(store.load(spark, path, any_settings=True)), rows_of(reader)) == (whole, any_one, whole)
    assert store.vacuum(spark, path) == n and len(os.listdir(f"{tmp_path}/s/data")) == 1 and rows_of(store.load(spark, path)) == whole
    store.append(spark.createDataFrame([("s0", 99, "f0")], ROW), path)
    assert [v for s, v, f in rows_of(store.load(spark, path)) if (s, f) == ("s0", "f0")] == [99]
    assert store.compact(spark, path).number == store.compact(spark, path).number == n + 3


def test_a_batch_committed_while_merging_stays(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/s"
    for v in (1, 2):
        store.append(spark.createDataFrame([("a", v, "f")], ROW), path)
    write = store._write

    def slow(rows, where):
        made = write(rows, where)
        monkeypatch.setattr(store, "_write", write)
        store.append(spark.createDataFrame([("a", 3, "f"), ("b", 3, "f")], ROW), path)
        return made

    monkeypatch.setattr(store, "_write", slow)
    store.compact(spark, path)
    assert rows_of(store.load(spark, path)) == [("a", 3, "f"), ("b", 3, "f")] and len(store.snapshot(spark, path).folders) == 2


def test_writers_at_once_lose_no_commit(spark, tmp_path):
    path = f"{tmp_path}/s"
    write = lambda k: store.append(spark.createDataFrame([(f"s{k}", k, "f")], ROW), path)
    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert rows_of(store.load(spark, path)) == [(f"s{k}", k, "f") for k in range(8)] and store.snapshots(spark, path) == list(range(1, 9))


def test_only_the_partition_of_the_fingerprint_is_read(spark, tmp_path):
    path = f"{tmp_path}/s"
    store.append(spark.createDataFrame([("a", 1, "f"), ("b", 2, "g")], ROW), path)
    store.append(spark.createDataFrame([("c", 1, "g")], ROW), path)
    df = store.load(spark, path, fingerprint="f")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fingerprint" in plan and "Join" not in plan and len(df.inputFiles()) == 2


def test_a_batch_of_a_stream_is_stored_once(spark, tmp_path):
    path = f"{tmp_path}/s"
    for v, batch in ((1, 0), (2, 1), (2, 1), (1, 0)):
        store.append(spark.createDataFrame([("a", v, "f")], ROW), path, "q", batch)
    store.compact(spark, path)
    store.append(spark.createDataFrame([("a", 2, "f")], ROW), path, "q", 1)
    assert rows_of(store.load(spark, path)) == [("a", 2, "f")] and store.snapshot(spark, path).streams == {"q": 1} and store.snapshots(spark, path) == [1, 2, 3]


@pytest.fixture
def bare(monkeypatch):
    """Each source of the table that ``pairs`` gives has its whole length as its segment, and no XML is made, so that a run takes a moment only."""

    def analyse(scored, part, settings, people):
        none = part.sparkSession.createDataFrame([], "source_path string, pos long, start_seconds double, end_seconds double, start_frame long, end_frame long, kind string, motion double, zoom double, movement string, confidence double, person double, windows long")
        return run.selects(none, scored)

    monkeypatch.setattr(run, "analyse", analyse)
    monkeypatch.setattr(run, "export", lambda *_: None)


def test_events_of_a_run(spark, tmp_path, prober, bare):  # noqa: F811
    for k in range(4):
        clip(tmp_path / f"in/c{k}_96x64@12.bgr24", [0] * 24)
    (tmp_path / "in/broken.bgr24").write_bytes(b"?")
    settings = Settings(height=64, fps=12.0)

    def go(name):
        watch = progress.Progress(spark, f"{tmp_path}/p", name)
        return run.run_folder(spark, f"{tmp_path}/in", "bgr24", settings, f"{tmp_path}/s", f"{tmp_path}/x-{name}", lambda part: part, prober, watch, slices=3)

    first = go("one")
    assert first == {"scanned": 5, "analysed": 4, "reused": 0, "failed": 1, "exported": 4}
    seen = progress.events(spark, f"{tmp_path}/p").where("run = 'one'").orderBy("number").collect()
    assert [(r.phase, r.state) for r in seen][:3] == [("scan", "started"), ("scan", "finished"), ("analyse", "started")]
    assert seen[1].counts == {"scanned": 5, "failed": 1} and [(r.phase, r.state) for r in seen][-2:] == [("export", "started"), ("export", "finished")]
    done = [r for r in seen if r.phase.startswith("slice") and r.state == "finished"]
    assert len(done) == next(r.counts for r in seen if r.phase == "analyse" and r.state == "finished")["slices"] and sum(r.counts["segments"] for r in done) == 4 and len(store.snapshots(spark, f"{tmp_path}/s")) == len(done)
    assert [r.number for r in seen] == list(range(1, len(seen) + 1)) and all(a.at <= b.at for a, b in zip(seen, seen[1:]))
    assert go("two") == {**first, "reused": 4}
    ends = {(r.run, os.path.basename(r.source_path)): (r.ok, r.segments, r.from_store) for r in progress.outcomes(spark, f"{tmp_path}/p").collect()}
    assert ends[("one", "c0_96x64@12.bgr24")] == (True, 1, False) and ends[("two", "c0_96x64@12.bgr24")] == (True, 1, True)
    assert ends[("two", "broken.bgr24")] == (False, 0, False) and len(ends) == 10
    assert {r.state for r in progress.latest(spark, f"{tmp_path}/p").collect()} == {"finished"}


def test_a_cancelled_run_keeps_what_is_done(spark, tmp_path, bare):
    settings, watch = Settings(), progress.Progress(spark, f"{tmp_path}/p", "cut")
    sources = spark.createDataFrame([(f"/in/c{k}", 1, 1, 96, 64, 2.0, 24, 12, False, False) for k in range(6)], "source_path string, mtime long, size long, width int, height int, duration_seconds double, duration_frames long, timebase long, ntsc boolean, slow_motion boolean")
    calls, at = [], []

    def slow(part):
        if part.isEmpty():
            return part
        calls.append(1)
        return part if len(calls) < 2 else part.where(F.udf(lambda _: time.sleep(90) or True, "boolean")("source_path"))

    def stop():
        while len(calls) < 2:
            time.sleep(0.05)
        at.append(time.monotonic())
        watch.cancel()  # the slice's jobs have not started yet

    go = lambda pairs, p: run.resume(pairs, sources, settings, f"{tmp_path}/s", None, p, slices=4)
    stopper = threading.Thread(target=stop)
    stopper.start()
    with pytest.raises(progress.Cancelled):
        go(slow, watch)
    stopper.join()
    assert time.monotonic() - at[0] < 60
    assert {(r.phase, r.state) for r in progress.latest(spark, f"{tmp_path}/p").collect()} >= {("analyse", "cancelled")}
    held = store.load(spark, f"{tmp_path}/s").select("source_path").distinct().count()
    assert 0 < held < 6 and len(store.snapshots(spark, f"{tmp_path}/s")) == 1
    assert spark.range(3).count() == 3  # later jobs of the session aren't touched
    assert go(lambda part: part, None)[1].first().asDict() == {"scanned": 6, "analysed": 6, "reused": held, "failed": 0, "exported": 6}


def test_a_phase_that_fails_says_so(spark, tmp_path):
    watch = progress.Progress(spark, f"{tmp_path}/p", "bad")
    with pytest.raises(ZeroDivisionError), watch.phase("scan"):
        1 / 0
    row = progress.latest(spark, f"{tmp_path}/p").first()
    assert (row.phase, row.state, row.detail) == ("scan", "failed", "division by zero")
    watch.cancel()
    with pytest.raises(progress.Cancelled), watch.phase("export"):
        pass
    with pytest.raises(FileExistsError):
        progress.Progress(spark, f"{tmp_path}/p", "bad").emit("scan", "started")


def test_events_of_micro_batches(spark, tmp_path):
    watch = progress.Progress(spark, f"{tmp_path}/p", "live")
    spark.createDataFrame([("a", 1), ("b", 2)], "source_path string, v long").write.parquet(f"{tmp_path}/in")
    with watch.streams():
        incremental.run_new(spark, f"{tmp_path}/in", "source_path string, v long", lambda d: d.withColumn("fingerprint", F.lit("f")), f"{tmp_path}/s", f"{tmp_path}/ck").awaitTermination()
    seen = progress.events(spark, f"{tmp_path}/p").orderBy("number").collect()
    assert [r.state for r in seen][0] == "started" and [r.state for r in seen][-1] == "finished"
    assert sum(r.counts["rows"] for r in seen if r.state == "batch") == 2
