"""Catalog, probe, motion kernels, store, export and continuous runs."""

import xml.etree.ElementTree as ET

import numpy as np
from pyspark.sql import functions as F

from tidereel.functions import motion
from tidereel.operators import layout
from tidereel.sources import catalog, frames, store
from tidereel.streaming import incremental


def scene(w=96, h=64, dx=0, dy=0, scale=1.0, turn=0.0):
    y, x = np.mgrid[0:h, 0:w].astype(float)
    x, y = x - w / 2 - dx, y - h / 2 - dy
    x, y = (x * np.cos(turn) + y * np.sin(turn)) / scale, (y * np.cos(turn) - x * np.sin(turn)) / scale
    return (127 + 60 * np.sin(x / 3.1) * np.cos(y / 2.7) + 50 * np.sin((x + 2 * y) / 7.3)).astype(np.uint8)


def test_motion_kernels():
    still = scene()
    assert motion.pair_motion(still, still)["motion"] < 0.25
    pan = motion.pair_motion(still, scene(dx=4, dy=1))
    assert pan["movement"] == "PanTilt" and pan["motion"] > 2
    assert motion.pair_motion(still, scene(scale=1.06))["movement"] == "Zoom"
    assert motion.pair_motion(still, scene(turn=0.06))["movement"] == "Roll"
    assert motion.pair_motion(still, still[:-1]) is None
    assert motion.thumbnail(np.full((48, 96, 3), 200, np.uint8)).shape == (48, 96)


def test_outliers_do_not_bend_the_fit():
    """A global shift of which a quarter of the vectors departs; what the refined model explains is counted anew."""
    w, h = 192, 108
    grid = motion.patch_centres(w, h) - np.array([(w - 1) / 2, (h - 1) / 2])
    d = np.tile([3.0, -1.0], (len(grid), 1))
    d[::4] = [-8.0, 9.0]
    m, inliers, residual = motion.fit_affine(grid, d, w, h)
    assert np.allclose(m, [[3, -1], [0, 0], [0, 0]]) and inliers == len(grid) - len(grid[::4]) and residual < 1e-6
    rng = np.random.default_rng(2)
    d = np.array([2.0, 1.0]) + rng.normal(0, 0.9, (len(grid), 2))
    m, inliers, residual = motion.fit_affine(grid, d, w, h)
    left = np.hypot(*(d - np.column_stack([np.ones(len(grid)), grid]) @ m).T)
    assert inliers <= (left <= 1.5).sum() and residual <= 1.5
    assert motion.fit_affine(np.array([[x, 5.0] for x in range(12)]), np.ones((12, 2)), w, h) is None  # a line: the last pivot vanishes


def test_local_motion_is_ignored():
    still = scene()
    one, two = still.copy(), still.copy()
    one[18:30, 18:30], two[18:30, 28:40] = 10, 240
    assert motion.pair_motion(one, two)["motion"] < 1.0


def test_scores_are_in_source_pixels(spark):
    big = lambda k: np.repeat(np.repeat(scene(w=256, h=144, dx=2 * k), 2, 0), 2, 1)
    bgr = lambda a: np.repeat(a[..., None], 3, 2)
    rows = [("g", k, 512, 288, bytearray(big(k).tobytes())) for k in range(2)] + [("c", k, 512, 288, bytearray(bgr(big(k)).tobytes())) for k in range(2)] + [("s", k, 256, 144, bytearray(scene(w=256, h=144, dx=2 * k).tobytes())) for k in range(2)]
    got = {r.source_path: r.motion for r in frames.pair_scores(spark.createDataFrame(rows, "source_path string, frame_idx long, width int, height int, pixels binary")).collect()}
    assert abs(got["g"] - 2 * got["s"]) < 1e-6 and abs(got["c"] - got["g"]) < 0.3


def test_pair_scores(spark):
    rows = [("a", k, 96, 64, bytearray(scene(dx=2 * k).tobytes())) for k in range(6)] + [("b", 0, 96, 64, None), (None, 1, 1, 1, bytearray(b"x"))]
    t = spark.createDataFrame(rows, "source_path string, frame_idx long, width int, height int, pixels binary")
    got = frames.pair_scores(t, chunk=4).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in got] == [1, 2, 3, 4, 5] and {r.movement for r in got} == {"PanTilt"}


def test_catalog(spark, tmp_path):
    deep = "/".join(["x"] * 70)
    for name in ("A.MP4", "b.mov", "c.txt", "target/y.mp4", "clips/real.mp4", "_c.mov", ".d.mov", "_sub/z.mp4", f"{deep}/node_modules/n.mp4", f"{deep}/deep.mp4"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(b"x")
    got = catalog.catalog(spark, str(tmp_path), "mp4,mov").collect()
    assert sorted(r.source_path.rsplit("/", 1)[1] for r in got) == [".d.mov", "A.MP4", "_c.mov", "b.mov", "deep.mp4", "real.mp4", "z.mp4"]


def test_probe(spark):
    good = '{"streams":[{"codec_type":"audio"},{"codec_type":"video","width":1920,"height":1080,"avg_frame_rate":"30000/1001","r_frame_rate":"30/1"}],"format":{"duration":"4.0"}}'
    rows = spark.createDataFrame([(1, good), (2, '{"streams":[]}'), (3, None), (4, "broken")], "id int, json string")
    got = {r.id: r for r in catalog.probe(rows).collect()}
    assert (got[1].width, got[1].timebase, got[1].ntsc, got[1].duration_frames, got[1].error) == (1920, 30, True, 120, None)
    assert {got[k].error for k in (2, 3, 4)} == {"no video stream"}


def test_resumed_run_equals_fresh(spark, tmp_path):
    fresh = spark.createDataFrame([("a", 1, 0.5, 3.0, "f"), ("b", 2, 1.0, None, "f")], "source string, size int, motion double, person double, fingerprint string")
    store.append(fresh, f"{tmp_path}/s")
    again = store.load(spark, f"{tmp_path}/s").select(*fresh.columns)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, fresh.collect()), key=str)
    files = spark.createDataFrame([("a", 1, "f"), ("b", 3, "f"), ("c", 1, "f")], "source string, size int, fingerprint string")
    hit, miss = store.split_work(files, again, ["source", "size", "fingerprint"])
    assert [r.source for r in hit.collect()] == ["a"] and sorted(r.source for r in miss.collect()) == ["b", "c"]


def test_export(spark):
    s = spark.createDataFrame([("a&b.mov", 0.0, 2.0, 0, 50, 100), ("a&b.mov", 3.0, 4.0, 75, 130, 100), ("c.mov", 5.0, 6.0, 125, 150, 100)], "source string, start_seconds double, end_seconds double, start_frame long, end_frame long, frames long")
    root = ET.fromstring("\n".join(store.timeline_xml(layout.layout(s, "source").withColumn("url", F.col("source")))))
    clips = root.findall(".//clipitem")
    assert [(c.find("in").text, c.find("out").text, c.find("start").text, c.find("end").text) for c in clips] == [("0", "50", "0", "50"), ("75", "100", "50", "75")]
    assert [c.find("file/pathurl") is not None for c in clips] == [True, False]


def test_export_in_parts(spark, tmp_path):
    s = spark.createDataFrame([(f"{k % 3}&.mov", float(k), k + 1.0, k * 25, k * 25 + 25, 10**6) for k in range(200)], "source string, start_seconds double, end_seconds double, start_frame long, end_frame long, frames long")
    items = layout.layout(s, "source").withColumn("url", F.col("source"))
    store.write_timeline_xml(items, f"{tmp_path}/x")
    parts = [p.read_text() for p in sorted((tmp_path / "x").glob("part-*"))]
    assert sum("<clipitem" in p for p in parts) > 1
    assert "".join(parts).splitlines() == list(store.timeline_xml(items))


def test_continuous_run(spark, tmp_path):
    def go():
        incremental.run_new(spark, f"{tmp_path}/in", "source string, v double", lambda d: d.withColumn("fingerprint", F.lit("f")), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        return store.load(spark, f"{tmp_path}/out").count()

    spark.createDataFrame([("a", 1.0)], "source string, v double").write.parquet(f"{tmp_path}/in")
    assert go() == 1
    spark.createDataFrame([("b", 1.0), ("c", 2.0)], "source string, v double").write.mode("append").parquet(f"{tmp_path}/in")
    assert go() == 3


def one_by_one(pos, d, w, h):
    """The robust fit with its triples solved and judged in turn."""
    from itertools import combinations, islice

    a = np.column_stack([np.ones(len(pos)), pos])

    def judged(rows):
        g = a[rows].T @ a[rows]
        if np.linalg.matrix_rank(g, tol=1e-6) < 3:
            return None
        m = np.linalg.solve(g, a[rows].T @ d[rows])
        r = np.hypot(*(d - a @ m).T)
        return (m, r <= 1.5, int((r <= 1.5).sum()), float(r[r <= 1.5].mean()) if (r <= 1.5).any() else 0.0)

    best = judged(np.arange(len(pos)))
    best = best if best and best[2] else None
    far = (pos**2).sum(1)
    quarter = [(p[0] >= 0) + 2 * (p[1] >= 0) for p in pos]
    lead = [max((i for i in range(len(pos)) if quarter[i] == q), key=lambda i: (far[i], i)) for q in range(4) if q in quarter]
    seeds = [*lead, *(i for i in sorted(range(len(pos)), key=lambda i: (-far[i], i)) if i not in lead)][:16]
    for t in islice(combinations(seeds, 3), 200):
        (ux, uy), (vx, vy) = pos[t[1]] - pos[t[0]], pos[t[2]] - pos[t[0]]
        if abs(ux * vy - uy * vx) / 2 < 10:
            continue
        new = judged(list(t))
        if new and new[2] and (best is None or new[2] > best[2] or (new[2] == best[2] and new[3] + 1e-4 < best[3])):
            best = new
    if best is None or best[2] < 10 or (np.ptp(pos[best[1]], axis=0) < 0.25 * np.array([w, h])).any():
        return None
    m = judged(np.flatnonzero(best[1]))[0]
    r = np.hypot(*(d - a @ m).T)[best[1]]
    return (m, int((r <= 1.5).sum())) if (r <= 1.5).sum() >= 10 else None


def test_fits_together_equal_fits_one_by_one():
    w, h = 256, 144
    grid = motion.patch_centres(w, h) - np.array([(w - 1) / 2, (h - 1) / 2])
    rng, found = np.random.default_rng(8), 0
    for share in (0.2, 0.6, 1.0) * 12:
        pos = grid[rng.random(len(grid)) < share]
        d = np.round(pos @ rng.normal(0, 0.03, (2, 2)) + rng.normal(0, 4, 2) + rng.normal(0, 0.4, pos.shape))
        off = rng.random(len(pos)) < rng.choice([0.0, 0.4])
        d[off] = rng.integers(-10, 11, (off.sum(), 2))
        got, want = motion.fit_affine(pos, d, w, h), one_by_one(pos, d, w, h)
        assert (got is None) == (want is None)
        if want is not None:
            found += 1
            assert got[1] == want[1] and np.allclose(got[0], want[0], atol=1e-8)
    assert found > 20 and motion.fit_affine(grid[:0], grid[:0], w, h) is None
