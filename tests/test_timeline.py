import pytest

from tidereel.functions import media
from tidereel.operators import folds, layout, selection, windows
from tidereel.plans import queries as plans

G, S, M = folds.MOVE, folds.SUBJECT, folds.SLOW


def segments(spark, rows, length=None):
    """(start, end, kind, motion, person, zoom, windows) of one source, ten frames a second."""
    full = []
    for k, r in enumerate(rows):
        start, end, kind, motion, person, zoom, n = (*r, *(None, 0.0, None, 0.0, 1)[len(r) - 2 :])[:7] if len(r) < 7 else r
        full.append(("a", k, float(start), float(end), int(start * 10), int(end * 10), kind, float(motion), float(zoom), "PanTilt", 0.9, person, n, length))
    return spark.createDataFrame(full, "src string, pos long, start_seconds double, end_seconds double, start_frame long, end_frame long, kind string, motion double, zoom double, movement string, confidence double, person double, windows long, length double")


def spans(df):
    return [(round(r.start_seconds, 3), round(r.end_seconds, 3), r.kind) for r in df.orderBy("start_seconds").collect()]


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(0, 1, G, 2), (1, 2, G, 1)], [(0, 2, G)]),
        ([(0, 1, G, 2), (1.02, 2, G, 1)], [(0, 2, G)]),
        ([(0, 1, S, 0.5, 0.9), (1, 2, G, 3.5), (2, 3, S, 0.4, 0.95)], [(0, 3, S)]),
        ([(0, 1, G, 2), (1, 2, S, 0.2, 0.9)], [(0, 1, G), (1, 2, S)]),
        ([(4.5, 6.5, G, 2), (0, 1, G, 2, None, 3.0)], [(0, 1, G), (4.5, 6.5, G)]),
    ],
)
def test_merge(spark, rows, want):
    assert spans(folds.merge_runs(segments(spark, rows), "src")) == want


def test_smoothing_goes_left_to_right(spark):
    rows = [(k, k + 1, "AB"[k % 2], 1) for k in range(6)]
    got = folds.smooth_and_merge(segments(spark, rows), "src").orderBy("pos").collect()
    assert "".join(r.kind for r in got) == "AAAAAB"


@pytest.mark.parametrize(
    "rows, length, want",
    [
        ([(0, 5, S, 0.2, 0.82), (20, 23, G, 4.0)], 45, [(0, 5, S), (20, 23, G)]),
        ([(0, 20, G, 4), (10, 30, G, 5), (70, 80, M, 2)], 130, [(3, 30, G), (70, 80, M)]),
        ([(8.75, 10, G, 7.7, None, 5.98)], 10.08, []),
        ([(18.1, 19.8, G, 2.4, None, 0.0, 2)], 20, []),
        ([(12, 15, G, 2.4, None, 0.0, 3)], 20, [(12, 15, G)]),
        ([(2, 3.5, S, 0.3, 0.61)], 20, []),
        ([(2, 3.5, S, 0.3, 0.82)], 20, [(2, 3.5, S)]),
    ],
)
def test_select(spark, rows, length, want):
    assert spans(selection.select(segments(spark, rows, float(length)), "src")) == want


def test_window_count_and_threshold(spark):
    df = spark.range(40).selectExpr("1 as k", "id", "cast(id as double) / 10 as v")
    assert windows.hop_means(df, "k", ["id"], ["v"]).count() == (40 - 12) // 3 + 1
    got = windows.auto_threshold(spark.range(10).selectExpr("1 as k", "cast(id + 1 as double) / 4 as v"), "k", "v").first()
    assert (got.baseline, got.threshold) == (0.5, 1.25)  # the second of ten


def test_retention_and_layout(spark):
    sources = spark.createDataFrame([("a", 9.0, 90), ("b", 4.0, 40)], "src string, length double, frames long")
    kept = selection.retain(sources, segments(spark, [(0, 5, G, 4)], 9.0), "src")
    assert {(r.src, r.kind) for r in kept.collect()} == {("a", G), ("b", folds.STATIC)}
    rows = layout.layout(kept.join(sources.select("src", "frames"), "src"), "src").orderBy("item_idx").collect()
    assert [r.seq_start for r in rows] == [0, rows[0].seq_end]


def test_expressions(spark):
    df = spark.createDataFrame([("C:\\My Videos\\clip 1.mov", "30000/1001")], "p string, r string")
    num, den = media.parse_rate(df.r)
    base, drop = media.timebase(num, den)
    got = df.select(media.file_url(df.p), num, den, base, drop).first()
    assert tuple(got) == ("file://localhost/C:/My%20Videos/clip%201.mov", 30000, 1001, 30, True)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, name):
    import glob
    import os

    import duckdb

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = plans.queries()[name](spark, d)
    cols = sorted(got.columns)
    want = con.execute(plans.ORACLES[name])
    at = [x[0] for x in want.description]
    assert sorted(at) == cols
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(repr(tuple(r[at.index(c)] for c in cols)) for r in want.fetchall())


def test_layout_is_dealt_by_ranges(spark):
    from itertools import accumulate

    rows = [(None if k % 11 == 0 else "hot" if k % 3 else f"s{k % 7}", float(k), k + 1.0 + k % 4, k * 25, k * 25 + 30, 10**6) for k in range(1, 900)]
    items = spark.createDataFrame(rows, "src string, start_seconds double, end_seconds double, start_frame long, end_frame long, frames long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = layout.layout(items, "src")
        got = sorted(out.collect(), key=lambda r: r.item_idx)
        assert len([p for p in out.rdd.glom().map(len).collect() if p]) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    rows.sort(key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    ends = list(accumulate(round((r[2] - r[1]) * 25) for r in rows))
    names = list(dict.fromkeys(r[0] for r in rows))
    assert [(r.src, r.item_idx, r.in_frame, r.seq_start, r.seq_end) for r in got] == [(r[0], k + 1, r[3], ([0] + ends)[k], ends[k]) for k, r in enumerate(rows)]
    assert [r.file_idx for r in got] == [names.index(r[0]) + 1 for r in rows]
    assert [r.full_record for r in got] == [k == 0 or rows[k - 1][0] != r[0] for k, r in enumerate(rows)]


def test_settings():
    from tidereel.plans.settings import Settings, even_width

    assert Settings.mode("people").fingerprint != Settings.mode("people", motion_threshold=2.0).fingerprint == Settings.mode("people", motion_threshold=2.0).fingerprint
    assert (even_width(1920, 1080, 360), even_width(1920, 1080, 240), even_width(1, 0, 5)) == (640, 428, 0)
    for bad in ({"height": 0}, {"fps": 0}, {"window_seconds": 0}, {"person_threshold": 1.1}, {"fps": 1.0}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_run_end_to_end(spark, tmp_path):
    """A pan, a still clip and one shorter than a window; what is resumed equals what is fresh."""
    import xml.etree.ElementTree as ET

    from tidereel.plans import run
    from tidereel.sources import store

    pair = lambda s, k, m: (s, k, m, 0.1, 0.0, 0.0, 0.9, "PanTilt")
    pairs = spark.createDataFrame([pair("/v/a.mov", k, 2.0 if 24 <= k < 96 else 0.1) for k in range(1, 144)] + [pair("/v/b.mov", k, 0.0) for k in range(1, 60)] + [pair("/v/c.mov", 1, 9.0)], "source_path string, frame_idx long, motion double, zoom double, rotation double, shear double, confidence double, movement string")
    kind = "source_path string, mtime long, size long, width int, height int, duration_seconds double, duration_frames long, timebase long, ntsc boolean, slow_motion boolean, error string"
    row = lambda s, sec, e=None, size=9: (s, 5, size, 1920, 1080, sec, int(sec * 25), 25, False, False, e)
    rows = [row("/v/a.mov", 12.0), row("/v/b.mov", 5.0), row("/v/c.mov", 0.5), row("/v/d.mov", 0.0, "no duration")]
    sources, settings = spark.createDataFrame(rows, kind), run.Settings()
    chosen, counts = run.resume(pairs, sources, settings, f"{tmp_path}/s")
    first = sorted(map(tuple, chosen.collect()), key=str)
    got = {r.source_path: (r.kind, r.start_seconds, r.end_seconds) for r in chosen.collect()}
    # scores are doubled by the rate; means of eleven pairs pass 0.6 of the threshold until the window that ends after the pan
    assert got["/v/a.mov"][0] == "GimbalMove" and 1 <= got["/v/a.mov"][1] <= 2 and 8 <= got["/v/a.mov"][2] <= 9
    assert got["/v/b.mov"] == ("Static", 0.0, 5.0) and got["/v/c.mov"] == ("Static", 0.0, 0.5)
    assert tuple(counts.first()) == (4, 3, 0, 1, 3)
    again, counts = run.resume(pairs, sources, settings, f"{tmp_path}/s")
    assert sorted(map(tuple, again.collect()), key=str) == first and tuple(counts.first()) == (4, 3, 3, 1, 3)
    changed = spark.createDataFrame([row("/v/a.mov", 12.0, size=10), *rows[1:]], kind)
    again, counts = run.resume(pairs, changed, settings, f"{tmp_path}/s")
    assert sorted(map(tuple, again.collect()), key=str) == first and tuple(counts.first())[2] == 2
    items = store.described(run.timeline(chosen, sources.where("error is null")))
    root = ET.fromstring("\n".join(store.timeline_xml(items)))
    clips = root.findall(".//clipitem")
    assert [x.find("labels/label2").text for x in clips] == ["Forest", "Cerulean", "Cerulean"] and clips[0].find("comments").text.startswith("Selects: pan/tilt | source in ")
    assert clips[0].find("file/media/video/samplecharacteristics/width").text == "1920" and [x.find("start").text for x in clips] == ["0", *(x.find("end").text for x in clips[:-1])]
