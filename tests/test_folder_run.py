"""Packed frame files, and a run from a folder to the timeline's XML."""

import os
import sys
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sources import scene
from tidereel.plans import run
from tidereel.plans.settings import Settings, even_width
from tidereel.sources import catalog, frame_files, frames, store

PROBER = """
import json, os, re, sys
m = re.search(r"_(\\d+)x(\\d+)@(\\d+)", sys.argv[1])
if not m:
    sys.exit(3)
w, h, rate = map(int, m.groups())
n = os.path.getsize(sys.argv[1]) // (w * h * 3)
print(json.dumps({"streams": [{"codec_type": "audio"}, {"codec_type": "video", "width": w, "height": h, "avg_frame_rate": f"{rate}/1", "r_frame_rate": f"{rate}/1"}], "format": {"duration": str(n / rate)}}))
"""


def clip(path, shifts, w=96, h=64, tail=b""):
    """Frames of a scene moved by ``shifts``, as packed BGR."""
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"".join(np.repeat(scene(w, h, dx=s)[..., None], 3, 2).tobytes() for s in shifts) + tail)


@pytest.fixture
def pushing(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_frames_of_files(spark, tmp_path):
    clip(tmp_path / "a_96x64@24.bgr24", range(10), tail=b"short")
    clip(tmp_path / "sub/b_96x64@24.bgr24", [0, 1])
    (tmp_path / "c_96x64@24.bgr24").write_bytes(b"too short")
    (tmp_path / "d.bgr24").write_bytes(b"x" * 96 * 64 * 3)
    got = frame_files.read_frames(spark, str(tmp_path), f"{tmp_path}/gone_96x64@24.bgr24").select("*", F.octet_length("pixels").alias("size")).drop("pixels").collect()
    counts = {}
    for r in got:
        name = os.path.basename(r.source_path)
        counts[name] = counts.get(name, 0) + (r.frame_idx is not None)
        assert r.error is None and (r.width, r.height, r.size) == (96, 64, 96 * 64 * 3) or r.frame_idx is None and r.error
    assert counts == {"a_96x64@24.bgr24": 10, "b_96x64@24.bgr24": 2, "c_96x64@24.bgr24": 0, "d.bgr24": 0, "gone_96x64@24.bgr24": 0}
    assert frame_files.read_frames(spark, f"{tmp_path}/d.bgr24", stored="96x64@5").count() == 1


def test_a_long_file_spreads_over_tasks(spark, tmp_path):
    clip(tmp_path / "a_96x64@24.bgr24", [k % 7 for k in range(60)])
    whole = frame_files.read_frames(spark, str(tmp_path))
    cut = frame_files.read_frames(spark, str(tmp_path), task_bytes=96 * 64 * 3 * 8)
    assert (whole.rdd.getNumPartitions(), cut.rdd.getNumPartitions()) == (1, 8)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


def test_scores_of_files_equal_those_of_a_table(spark, tmp_path):
    clip(tmp_path / "a_96x64@12.bgr24", [2 * k for k in range(9)])
    rows = [(f"{tmp_path}/a_96x64@12.bgr24", k, 96, 64, bytearray(np.repeat(scene(dx=2 * k)[..., None], 3, 2).tobytes())) for k in range(9)]
    table = spark.createDataFrame(rows, "source_path string, frame_idx long, width int, height int, pixels binary")
    a, b = (sorted(map(tuple, frames.pair_scores(t, chunk=4).collect())) for t in (table, frame_files.read_frames(spark, str(tmp_path), task_bytes=40_000)))
    assert a == b and len(a) == 8


def test_height_and_rate_of_the_result(spark, tmp_path):
    clip(tmp_path / "a_96x64@24.bgr24", range(25))
    half = {r.frame_idx: bytes(r.pixels) for r in frame_files.read_frames(spark, str(tmp_path), fps=12).collect()}
    stored = {r.frame_idx: bytes(r.pixels) for r in frame_files.read_frames(spark, str(tmp_path)).collect()}
    assert half == {k: stored[2 * k] for k in range(13)}
    more = frame_files.read_frames(spark, str(tmp_path), fps=36).collect()
    assert len(more) == 38 and [bytes(r.pixels) for r in sorted(more, key=lambda r: r.frame_idx)][:4] == [stored[0], stored[0], stored[1], stored[2]]
    small = frame_files.read_frames(spark, str(tmp_path), height=30).first()
    assert (small.width, small.height, len(small.pixels)) == (even_width(96, 64, 30), 30, even_width(96, 64, 30) * 90) and small.width % 2 == 0
    for bad in ({"height": 0}, {"fps": -1}):
        with pytest.raises(Exception):  # noqa: B017  raised where Spark plans the source
            frame_files.read_frames(spark, str(tmp_path), **bad).count()


def test_filters_choose_files_and_ranges(spark, tmp_path, pushing):
    clip(tmp_path / "a_96x64@24.bgr24", range(20))
    clip(tmp_path / "b_96x64@24.bgr24", range(20))
    each = 96 * 64 * 3
    load = lambda: frame_files.read_frames(spark, str(tmp_path), task_bytes=each, pushdown="true")
    some = load().where((F.col("source_path") == f"{tmp_path}/a_96x64@24.bgr24") & (F.col("frame_idx") >= 5) & (F.col("frame_idx") < 9))
    assert sorted(r.frame_idx for r in some.collect()) == [5, 6, 7, 8]
    assert (load().rdd.getNumPartitions(), some.rdd.getNumPartitions()) == (40, 4)


def test_a_broken_frame_moves_no_window(spark):
    rows = [("s", k, 96, 64, bytearray(scene(dx=2 * k).tobytes())) for k in range(40)]
    rows[7] = ("s", 7, 96, 64, bytearray(b"broken"))
    t = spark.createDataFrame(rows, "source_path string, frame_idx long, width int, height int, pixels binary")
    pairs = frames.pair_scores(t, chunk=16)
    got = {r.frame_idx: r.motion for r in pairs.collect()}
    assert sorted(got) == list(range(1, 40)) and [k for k, m in got.items() if m is None] == [7, 8]
    for kept in (pairs, pairs.where("frame_idx not in (7, 8)")):
        assert [r.window_idx for r in run.window_scores(kept, Settings()).orderBy("window_idx").collect()] == list(range((40 - 12) // 3 + 1))


def test_capture_marks_of_a_long_file(spark, tmp_path):
    """The first 2 MiB and the last 6 MiB are looked at, what lies between isn't."""
    mark = b'slowAndQuickMotion captureFps="100p" formatFps="25p"'
    for name, at in (("head", 100), ("middle", 3 << 20), ("tail", (10 << 20) - 500)):
        data = bytearray(b"\xff" * (10 << 20))
        data[at : at + len(mark)] = mark
        (tmp_path / name).write_bytes(data)
    (tmp_path / "short").write_bytes(b'formatFps="25p"')
    files = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("head", "middle", "tail", "short", "gone")], "source_path string")
    got = {os.path.basename(r.source_path): tuple(r)[1:] for r in catalog.capture_marks(files).collect()}
    assert got == {"head": (100, 25, True), "middle": (None, None, False), "tail": (100, 25, True), "short": (None, 25, False), "gone": (None, None, False)}


@pytest.fixture
def prober(tmp_path):
    (tmp_path / "prober.py").write_text(PROBER)
    return [sys.executable, str(tmp_path / "prober.py")]


def test_sources_of_a_folder(spark, tmp_path, prober):
    clip(tmp_path / "in/a_96x64@25.bgr24", range(3), tail=b'captureFps="100p" formatFps="25p"')
    clip(tmp_path / "in/fast_96x64@50.bgr24", range(2), tail=b'formatFps="25p"')
    clip(tmp_path / "in/target/skipped_96x64@25.bgr24", range(3))
    (tmp_path / "in/bad.bgr24").write_bytes(b"?")
    got = {os.path.basename(r.source_path): r for r in catalog.sources(spark, f"{tmp_path}/in", "bgr24", prober).collect()}
    a = got["a_96x64@25.bgr24"]
    assert (a.width, a.height, a.timebase, a.ntsc, a.duration_frames, a.slow_motion, a.error) == (96, 64, 25, False, 3, True, None)
    assert got["fast_96x64@50.bgr24"].slow_motion and got["bad.bgr24"].error == "prober: exit code 3" and len(got) == 3
    gone = catalog.sources(spark, f"{tmp_path}/in", "bgr24", ["/no/such/prober"]).collect()
    assert {r.error for r in gone} == {"prober: FileNotFoundError"}


def test_from_a_folder_to_the_timeline(spark, tmp_path, prober):
    """A pan between still ends, a still clip, a broken file; resumed, changed and recovered."""
    clip(tmp_path / "in/pan_96x64@12.bgr24", [0] * 36 + [2 * (k + 1) for k in range(60)] + [120] * 36)
    clip(tmp_path / "in/still_96x64@12.bgr24", [0] * 24)
    (tmp_path / "in/broken.bgr24").write_bytes(b"?")
    settings = Settings(height=64, fps=12.0)
    opened = []

    def pairs(sources):
        opened.append(sorted(os.path.basename(r.source_path) for r in sources.select("source_path").collect()))
        return run.packed_pairs(settings)(sources)

    def go(xml):
        return run.run_folder(spark, f"{tmp_path}/in", "BGR24", settings, f"{tmp_path}/store", f"{tmp_path}/{xml}", pairs, prober)

    assert go("x1") == {"scanned": 3, "analysed": 2, "reused": 0, "failed": 1, "exported": 2}
    first = store.text_of(spark, f"{tmp_path}/x1")
    root = ET.fromstring(first)
    clips = {c.find("name").text: c for c in root.findall(".//clipitem")}
    pan, still = clips["pan_96x64@12.bgr24"], clips["still_96x64@12.bgr24"]
    assert 24 <= int(pan.find("in").text) <= 36 and 96 <= int(pan.find("out").text) <= 108 and pan.find("labels/label2").text == "Forest"
    assert (still.find("in").text, still.find("out").text, still.find("labels/label2").text) == ("0", "24", "Cerulean")
    assert root.find(".//sequence/rate/timebase").text == "12" and pan.find("file/pathurl").text.startswith("file://localhost/")
    batches = len(os.listdir(f"{tmp_path}/store"))
    assert go("x2") == {"scanned": 3, "analysed": 2, "reused": 2, "failed": 1, "exported": 2}
    assert store.text_of(spark, f"{tmp_path}/x2") == first and len(os.listdir(f"{tmp_path}/store")) == batches
    assert run.recover(spark, f"{tmp_path}/store", f"{tmp_path}/x3")["exported"] == 2
    assert store.text_of(spark, f"{tmp_path}/x3") == first
    clip(tmp_path / "in/still_96x64@12.bgr24", [0] * 36)
    assert go("x4")["reused"] == 1
    assert opened == [["pan_96x64@12.bgr24", "still_96x64@12.bgr24"], [], ["still_96x64@12.bgr24"]]
    assert run.recover(spark, f"{tmp_path}/store", f"{tmp_path}/x5")["scanned"] == 2
    assert store.text_of(spark, f"{tmp_path}/x5") == store.text_of(spark, f"{tmp_path}/x4") != first


def test_runs_without_a_clip(spark, tmp_path, prober):
    (tmp_path / "in").mkdir()
    call = lambda: run.run_folder(spark, f"{tmp_path}/in", "bgr24", Settings(), f"{tmp_path}/store", f"{tmp_path}/xml", run.packed_pairs(Settings()), prober)
    assert call() == run.NOTHING and not (tmp_path / "xml").exists()
    assert run.recover(spark, f"{tmp_path}/store", f"{tmp_path}/xml") == run.NOTHING and not (tmp_path / "xml").exists()
    (tmp_path / "in/bad.bgr24").write_bytes(b"?")
    assert call() == {**run.NOTHING, "scanned": 1, "failed": 1}
    root = ET.fromstring(store.text_of(spark, f"{tmp_path}/xml"))
    assert root.find(".//sequence/rate/timebase").text == "25" and root.findall(".//clipitem") == []
