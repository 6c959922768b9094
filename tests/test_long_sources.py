"""Folds, windows and selections over sources that cover many ranges, against plain sequential code."""

import random

import pytest

from tidereel.operators import folds, ranges

KINDS = [folds.MOVE, folds.SUBJECT, folds.SLOW, folds.STATIC]


def windows_of(rng, n, key):
    """Scores that keep close to the thresholds, so that kinds depend on what came before."""
    return [(key, k, rng.choice([0.05, 0.3, 0.9, 1.2, 2.5]), rng.choice([0.0, 0.3, 0.7, 1.4]), rng.choice([None, 0.1, 0.18, 0.3]), rng.choice([None, 0.2, 0.3, 0.5]), 1.5, key == "slow") for k in range(n)]


def plain_kinds(rows, person=0.42):
    out, last, kind = {}, None, None
    for key, i, m, z, c, p, t, slow in sorted(rows, key=lambda r: (r[0], r[1])):
        kind = folds.next_kind(kind if key == last else None, m / t, z / t, c or 0.0, (p or 0.0) / person, slow)
        last = key
        out[key, i] = kind
    return out


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_classifier_over_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = windows_of(rng, 900, "hot") + windows_of(rng, 200, "slow") + [r for k in range(30) for r in windows_of(rng, rng.randrange(1, 9), f"s{k}")]
    df = spark.createDataFrame(rows, "k string, i long, motion double, zoom double, confidence double, person double, threshold double, slow boolean")
    got = folds.classify(df, "k", "i", ranges=ranges)
    assert {(r.k, r.i): r.kind for r in got.collect()} == plain_kinds(rows)
    assert set(got.columns) == {*df.columns, "kind"}


def test_maps_are_composed():
    import numpy as np

    rng = np.random.default_rng(4)
    maps = rng.integers(0, 4, (37, 4))
    state, want = np.arange(4), []
    for m in maps:
        state = m[state]
        want.append(state)
    assert (folds.composed(maps) == np.array(want)).all() and folds.composed(maps[:0]).shape == (0, 4)


def segments_of(rng, n, key, kinds, steady):
    """Segments of about a second; ``steady``: how often a kind or a gap stays as it is."""
    out, at, kind = [], 0.0, rng.choice(kinds)
    for k in range(n):
        if rng.random() > steady:
            kind = rng.choice(kinds)
        length = rng.choice([0.5, 1.0, 1.5])
        out.append((key, k, at, at + length, kind, rng.choice([1, 1, 1, 2])))
        at += length + (0.0 if rng.random() < steady else rng.choice([-0.25, 0.4, 1.6, 3.0, 9.0]))
    return out


def plain_runs(rows):
    """Smoothing and merging of one sorted list, written apart from the fold."""
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((list(r) for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        for a, b, c in zip(own, own[1:], own[2:]):
            room = 1.5 * max(b[3] - b[2], 1e-3)
            if b[5] == 1 and a[4] == c[4] != b[4] and abs(b[2] - a[3]) <= room and abs(c[2] - b[3]) <= room:
                b[4] = a[4]
        run, since, until, kind = 0, own[0][2], own[0][3], own[0][4]
        for n, r in enumerate(own):
            span = max(until - since, r[3] - r[2], 1e-3)
            if n and not (r[4] == kind and -span <= r[2] - until <= 1.5 * span):
                run, since = run + 1, r[2]
            until, kind = r[3], r[4]
            out[key, r[1]] = (r[4], run)
    return out


@pytest.mark.parametrize("ranges", [1, 3, 25])
@pytest.mark.parametrize("steady", [0.3, 0.97, 1.0])
def test_runs_over_ranges(spark, ranges, steady):
    """At 1.0 the hot source is one run over all of its ranges, whose length decides which gaps it bridges."""
    rng = random.Random(f"{ranges}{steady}")
    rows = segments_of(rng, 500, "hot", KINDS, steady) + segments_of(rng, 300, "two", KINDS[:2], 0.5) + [r for k in range(25) for r in segments_of(rng, rng.randrange(1, 7), f"s{k}", KINDS, 0.4)]
    df = spark.createDataFrame(rows, "k string, pos long, start_seconds double, end_seconds double, kind string, windows long")
    got = {(r.k, r.pos): (r.kind, r.run) for r in folds.smooth_and_merge(df, "k", ranges).collect()}
    assert got == plain_runs(rows)


def test_no_task_reads_a_whole_source(spark):
    """A source with nine tenths of all rows lies in many ranges of about the same size."""
    df = spark.range(20_000).selectExpr("if(id % 10 = 0, concat('s', id % 70), 'hot') k", "id pos", "cast(id as double) start_seconds", "id + 1.0d end_seconds", "if(id % 700 < 350, 'GimbalMove', 'Static') kind", "1L windows")
    sizes = sorted(ranges.ranged(df, "k", ["start_seconds", "pos"], 16).groupBy("__range").count().toPandas()["count"])
    assert len(sizes) > 12 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    assert folds.smooth_and_merge(df.where("false"), "k").count() == 0


def test_null_source_has_its_own_runs(spark):
    rows = [(None, k, k * 1.0, k + 1.0, "A", 2) for k in range(5)] + [("a", k, k * 1.0, k + 1.0, "A", 2) for k in range(5)]
    df = spark.createDataFrame(rows, "k string, pos long, start_seconds double, end_seconds double, kind string, windows long")
    assert {(r.k, r.run) for r in folds.smooth_and_merge(df, "k", 4).collect()} == {(None, 0), ("a", 0)}


def test_numbers_chunks_and_islands_over_ranges(spark):
    """Against sequential code, with a source that has most rows, a null one, ties, and chunks shorter than a window."""
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(400) / 4.0, rng.randrange(1, 30) / 4.0, k, rng.choice([None, 0.0, 1.0, 2.0])) for k in range(1500)]
    df = spark.createDataFrame([(k, s, s + e, p, v) for k, s, e, p, v in rows], "k string, s double, e double, pos long, v double")
    by = {k: sorted((r for r in df.collect() if r.k == k), key=lambda r: (r.s, r.e, r.pos)) for k in {r[0] for r in rows}}
    got = ranges.numbered(df, "k", ["s", "e", "pos"], 9).collect()
    assert {(r.k, r.pos): (r.i, r.n) for r in got} == {(k, r.pos): (i, len(own)) for k, own in by.items() for i, r in enumerate(own, 1)}
    cut = ranges.chunked(df, "k", ["s", "e", "pos"], 11, 40, 9).collect()
    assert {(r.k, r.i, r.part, r.own) for r in cut} == {(k, i, (i - 1) // 40 + more, not more) for k, own in by.items() for i in range(1, len(own) + 1) for more in (0, 1) if not more or (i - 1) % 40 >= 29}
    want = {}
    for k, own in by.items():
        top, island = None, 0
        for r in own:
            island += top is None or r.s > top
            top = r.e if top is None else max(top, r.e)
            want[k, r.pos] = island
    assert {(r.k, r.pos): r.island for r in ranges.islands(df, "k", "s", "e", "pos", 9).collect()} == want
    assert ranges.islands(df.where("false"), "k", "s", "e", "pos").count() == 0


def test_windows_in_chunks(spark, monkeypatch):
    """Means, centres, dominant labels and the order statistic of a long source, cut into short chunks."""
    from tidereel.operators import windows

    monkeypatch.setattr(windows, "_chunks", lambda df, key, order, rows: ranges.chunked(df, key, order, rows - 1, 20, 5))
    rng = random.Random(6)
    rows = [("hot" if k % 9 else f"s{k % 4}", k, rng.choice("xyz"), rng.choice([None, -1.0, 0.0, 1.0, 2.0, 3.0])) for k in range(600)]
    df = spark.createDataFrame(rows, "k string, t long, label string, v double")
    want_means, want_best, want_centre = {}, {}, {}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        for w, at in enumerate(range(12, len(own) + 1, 3)):
            window = own[at - 12 : at]
            values = [r[3] for r in window if r[3] is not None]
            want_means[k, w] = round(sum(values) / len(values), 6) if values else 0.0
            top = max(values, default=0.0)
            want_best[k, w] = next(r[2] for r in window if r[3] == top) if top > 0 else "none"
            want_centre[k, w] = window[6][1]
    assert {(r.k, r.window_idx): round(r.mean_v, 6) for r in windows.hop_means(df, "k", ["t"], ["v"]).collect()} == want_means
    assert {(r.k, r.window_idx): r.dominant for r in windows.dominant(df, "k", ["t"], "label", "v", "none").collect()} == want_best
    assert {(r.k, r.window_idx): r.centre for r in windows.centre_rows(df, "k", ["t"], "t").collect()} == want_centre
    low = {k: sorted(r[3] for r in rows if r[0] == k and r[3] is not None) for k in {r[0] for r in rows}}
    got = {r.k: r.baseline for r in windows.auto_threshold(df, "k", "v").collect()}
    assert got == {k: min(v[len(v) * 10 // 100], 1.2) for k, v in low.items()}
    bare = windows.auto_threshold(spark.createDataFrame([("a", None)], "k string, v double"), "k", "v").first()
    assert (bare.baseline, bare.threshold) == (0.5, 1.25)
