"""Registered queries of the timeline operators on the test tables, with their SQL.

``events`` stands for a table of windows: user for source, row number for
time. Each query runs over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidereel.functions import media
from tidereel.operators import folds, layout, selection, windows
from tidereel.plans import run

ORDER = ["ts", "event_id"]
c = F.col


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


NUM = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"
EMIT = "i >= 12 AND (i - 12) % 3 = 0"


def hop_windows(spark, d):
    out = windows.hop_means(_events(spark, d), "user_id", ORDER, ["value"])
    return out.select("user_id", "window_idx", "start_seconds", "end_seconds", _r("mean_value"))


def pair_delta(spark, d):
    w = windows.ordered("user_id", *ORDER)
    pairs = _events(spark, d).withColumn("delta", c("value") - F.lag("value").over(w))
    return windows.hop_means(pairs, "user_id", ORDER, ["delta"], pairs=True).select("user_id", "window_idx", _r("mean_delta"))


def centre_sample(spark, d):
    return windows.centre_rows(_events(spark, d), "user_id", ORDER, "value")


def dominant_type(spark, d):
    return windows.dominant(_events(spark, d), "user_id", ORDER, "event_type", "value", "view")


def auto_threshold(spark, d):
    return windows.auto_threshold(_events(spark, d).withColumn("score", c("value") / 10), "user_id", "score").select("user_id", _r("baseline"), _r("threshold"))


def _scored(spark, d):
    e = windows.numbered(_events(spark, d), "user_id", *ORDER)
    return e.select("user_id", c("i").cast("long").alias("i"), (c("value") / 50).alias("motion"), ((c("event_id") % 5) / 4).alias("zoom"), ((c("event_id") % 10) / 20).alias("confidence"), F.when(c("event_type").isin("view", "error"), (c("event_id") % 9) / 16).alias("person"), F.lit(1.5).alias("threshold"), (c("user_id") % 5 == 0).alias("slow"))


def hysteresis(spark, d):
    return folds.classify(_scored(spark, d), "user_id", "i").select("user_id", "i", "kind")


SCORED = f"""{NUM}, s AS (SELECT user_id, i, value / 50 / 1.5::DOUBLE AS m, (event_id % 5)::DOUBLE / 4 / 1.5::DOUBLE AS z, (event_id % 10)::DOUBLE / 20 AS conf,
 coalesce(CASE WHEN event_type IN ('view', 'error') THEN (event_id % 9)::DOUBLE / 16 END / 0.42::DOUBLE, 0) AS p, user_id % 5 = 0 AS slow FROM e)"""


def _step(prev: str) -> str:
    present = f"(n.p >= CASE WHEN {prev} = 'StaticSubject' THEN 0.65::DOUBLE ELSE 1.0::DOUBLE END)"
    stay, breaks = f"coalesce({prev} = 'GimbalMove', false)", f"(coalesce({prev} = 'StaticSubject', false) AND {present})"
    coherent = f"(n.conf >= CASE WHEN {stay} THEN 0.15::DOUBLE WHEN {breaks} THEN 0.40::DOUBLE ELSE 0.20::DOUBLE END OR n.z >= 0.55::DOUBLE)"
    slow = f"(n.slow AND ((n.m >= CASE WHEN {prev} = 'SlowMotion' THEN 0.10::DOUBLE WHEN {breaks} THEN 0.40::DOUBLE ELSE 0.20::DOUBLE END AND {coherent}) OR n.z >= 0.15::DOUBLE))"
    move = f"(n.m >= CASE WHEN {stay} THEN 0.60::DOUBLE WHEN {breaks} THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AND {coherent})"
    return f"CASE WHEN {slow} THEN 'SlowMotion' WHEN {move} THEN 'GimbalMove' WHEN {present} THEN 'StaticSubject' END"


def _segments(spark, d):
    """Segments of each user: one for each event, a second apart, partly overlapping; kinds and scores from the columns."""
    e = windows.numbered(_events(spark, d), "user_id", *ORDER)
    t, k = c("event_type"), c("event_id")
    kind = F.when(t.isin("click", "signup"), folds.MOVE).when(t == "view", folds.SUBJECT).when(t == "purchase", folds.SLOW).otherwise(folds.STATIC)
    start = (c("i") * 2).cast("double")
    end = start + 0.5 + (k % 8) / 4
    move = F.element_at(F.array(*[F.lit(x) for x in ("PanTilt", "Zoom", "Roll", "Complex")]), (k % 4 + 1).cast("int"))
    return e.select(
        "user_id", c("i").cast("long").alias("pos"), start.alias("start_seconds"), end.alias("end_seconds"), (start * 25).cast("long").alias("start_frame"), F.round(end * 25).cast("long").alias("end_frame"), kind.alias("kind"), (c("value") / 17).alias("motion"),
        ((k % 13) / 4).alias("zoom"), move.alias("movement"), ((k % 10) / 10).alias("confidence"), F.when(t.isin("view", "error"), (k % 9) / 8).alias("person"), (1 + k % 3).cast("long").alias("windows"), F.lit(80.0).alias("length"),
    )


SEG = f"""{NUM}, g AS (SELECT user_id, i AS pos, (i * 2)::DOUBLE AS start_seconds, (i * 2)::DOUBLE + 0.5 + (event_id % 8)::DOUBLE / 4 AS end_seconds, i * 50 AS start_frame,
 round(((i * 2)::DOUBLE + 0.5 + (event_id % 8)::DOUBLE / 4) * 25)::BIGINT AS end_frame,
 CASE WHEN event_type IN ('click', 'signup') THEN 'GimbalMove' WHEN event_type = 'view' THEN 'StaticSubject' WHEN event_type = 'purchase' THEN 'SlowMotion' ELSE 'Static' END AS kind,
 value / 17 AS motion, (event_id % 13)::DOUBLE / 4 AS zoom, CASE event_id % 4 WHEN 0 THEN 'PanTilt' WHEN 1 THEN 'Zoom' WHEN 2 THEN 'Roll' ELSE 'Complex' END AS movement,
 (event_id % 10)::DOUBLE / 10 AS confidence, CASE WHEN event_type IN ('view', 'error') THEN (event_id % 9)::DOUBLE / 8 END AS person, 1 + event_id % 3 AS windows, 80.0::DOUBLE AS length FROM e)"""
RANK = "CASE movement WHEN 'Complex' THEN 4 WHEN 'Roll' THEN 3 WHEN 'Zoom' THEN 2 WHEN 'PanTilt' THEN 1 ELSE 5 END"


def smooth_isolated(spark, d):
    return folds.smooth_and_merge(_segments(spark, d), "user_id").select("user_id", "pos", "kind")


SMOOTH = f"""{SEG}, w AS (SELECT *, lead(kind) OVER q AS nk, lead(start_seconds) OVER q AS ns, lag(end_seconds) OVER q AS pe FROM g WINDOW q AS (PARTITION BY user_id ORDER BY pos)),
 k AS (SELECT user_id, pos, kind FROM w WHERE pos = 1 UNION ALL SELECT n.user_id, n.pos,
 CASE WHEN n.windows = 1 AND n.nk = k.kind AND k.kind <> n.kind AND abs(n.start_seconds - n.pe) <= 1.5 * greatest(n.end_seconds - n.start_seconds, 0.001) AND abs(n.ns - n.end_seconds) <= 1.5 * greatest(n.end_seconds - n.start_seconds, 0.001) THEN k.kind ELSE n.kind END
 FROM k JOIN w n ON n.user_id = k.user_id AND n.pos = k.pos + 1)"""


def merge_runs(spark, d):
    out = folds.merge_runs(_segments(spark, d), "user_id")
    return out.select("user_id", c("run").cast("long").alias("run"), "start_seconds", "end_seconds", "kind", _r("motion"), "zoom", _r("confidence"), "person", "movement", "windows")


MERGE = f"""{SMOOTH}, h AS (SELECT g.* EXCLUDE (kind), k.kind FROM g JOIN k USING (user_id, pos)),
 r AS (SELECT user_id, pos, 0::BIGINT AS run, start_seconds AS since, end_seconds AS until, kind FROM h WHERE pos = 1 UNION ALL SELECT n.user_id, n.pos, CASE WHEN ok THEN r.run ELSE r.run + 1 END, CASE WHEN ok THEN r.since ELSE n.start_seconds END, n.end_seconds, n.kind
 FROM r JOIN h n ON n.user_id = r.user_id AND n.pos = r.pos + 1, LATERAL (SELECT n.kind = r.kind AND n.start_seconds - r.until BETWEEN -greatest(r.until - r.since, n.end_seconds - n.start_seconds, 0.001) AND 1.5 * greatest(r.until - r.since, n.end_seconds - n.start_seconds, 0.001) AS ok))"""


def coalesce_overlaps(spark, d):
    out = selection.coalesce_overlaps(_segments(spark, d), "user_id")
    return out.select("user_id", c("island").cast("long").alias("island"), "start_seconds", "end_seconds", "kind", _r("motion"), "zoom", _r("confidence"), "person", "windows", "movement")


ISLES = """o AS (SELECT *, max(end_seconds) OVER (PARTITION BY user_id ORDER BY start_seconds, end_seconds, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {src}),
 isle AS (SELECT *, sum(CASE WHEN top IS NULL OR start_seconds > top THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start_seconds, end_seconds, pos ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM o),
 co AS (SELECT user_id, island, min(start_seconds) AS start_seconds, max(end_seconds) AS end_seconds, min(start_frame) AS start_frame, max(end_frame) AS end_frame,
 CASE WHEN count(*) = 1 THEN min(kind) WHEN bool_or(kind = 'SlowMotion') THEN 'SlowMotion' WHEN bool_or(person IS NOT NULL) THEN 'StaticSubject' ELSE 'GimbalMove' END AS kind,
 sum(motion * windows) / sum(windows) AS motion, max(zoom) AS zoom, sum(confidence * windows) / sum(windows) AS confidence, max(person) AS person, sum(windows)::BIGINT AS windows, count(*) AS n,
 first(movement ORDER BY -({rank}), start_seconds, end_seconds, pos) AS mv FROM isle GROUP BY ALL)""".replace("{rank}", RANK)
ISLE_MOVE = "CASE WHEN n = 1 THEN mv WHEN kind = 'SlowMotion' THEN 'SlowMotion' WHEN kind IN ('StaticSubject', 'Static') THEN 'Subject' ELSE mv END AS movement"


def trim_edges(spark, d):
    return selection.edge_noise(selection.transition_handles(_segments(spark, d))).select("user_id", "pos", _r("start_seconds"), _r("end_seconds"), "start_frame", "end_frame")


def _trim(src: str, dst: str, applies: str, s_when: str, s_to: str, e_when: str, e_to: str) -> str:
    """One trim in three steps: rate, start, end."""
    return f"""{dst}0 AS (SELECT *, CASE WHEN end_seconds > start_seconds THEN (end_frame - start_frame) / (end_seconds - start_seconds) ELSE 25.0::DOUBLE END AS fps FROM {src}),
 {dst}1 AS (SELECT * REPLACE (CASE WHEN {applies} AND {s_when} AND ns > start_seconds THEN ns ELSE start_seconds END AS start_seconds, CASE WHEN {applies} AND {s_when} AND ns > start_seconds THEN round(ns * fps)::BIGINT ELSE start_frame END AS start_frame)
 FROM (SELECT *, least({s_to}, end_seconds - 1.0) AS ns FROM {dst}0)),
 {dst} AS (SELECT * EXCLUDE (fps, ns, ne) REPLACE (CASE WHEN {applies} AND {e_when} AND ne < end_seconds THEN ne ELSE end_seconds END AS end_seconds, CASE WHEN {applies} AND {e_when} AND ne < end_seconds THEN round(ne * fps)::BIGINT ELSE end_frame END AS end_frame)
 FROM (SELECT *, greatest({e_to}, start_seconds + 1.0) AS ne FROM {dst}1))"""


TRIM = f"""{SEG}, {_trim("g", "t", "kind = 'GimbalMove'", "(start_frame = 0 OR start_seconds <= 0.01)", "30.0 / fps", "end_seconds >= length - 0.01", "length - 30.0 / fps")},
 {_trim("t", "u", "kind = 'GimbalMove' AND person IS NULL", "start_seconds <= 1.5", "1.5::DOUBLE", "end_seconds >= length - 1.5", "length - 1.5")}"""


def reject_rules(spark, d):
    return selection.reject(_segments(spark, d)).select("user_id", "pos", "kind", "start_seconds", "end_seconds")


DUR, EDGE = "greatest(end_seconds - start_seconds, 0)", "(start_seconds <= 1.5 OR length - end_seconds <= 1.5)"
HOT = "(motion >= 3.8 OR zoom >= 2.5)"
RULES = f"""NOT (kind = 'GimbalMove' AND ({DUR} <= 0 OR (movement IN ('PanTilt', 'Roll', 'Complex') AND (({DUR} <= 2.4 AND (windows <= 2 OR confidence < 0.70::DOUBLE)) OR ({EDGE} AND {DUR} <= 3.2 AND (confidence < 0.80::DOUBLE OR windows <= 3)) OR ({DUR} <= 2.4 AND {HOT})))))
 AND NOT (kind = 'GimbalMove' AND {DUR} <= 3.2 AND {EDGE} AND start_seconds >= length - 3.6)
 AND NOT (kind <> 'SlowMotion' AND person IS NULL AND {DUR} <= 1.75 AND {HOT} AND ({EDGE} OR {DUR} <= 1.5))
 AND (windows >= 2 OR ({DUR} >= 1.25 AND CASE WHEN kind = 'GimbalMove' THEN motion >= 3.1 OR zoom >= 1.8 WHEN kind IN ('StaticSubject', 'Static') THEN coalesce(person, 0) >= 0.72::DOUBLE WHEN kind = 'SlowMotion' THEN motion >= 1.2 OR zoom >= 0.8 ELSE false END))"""


def source_selection(spark, d):
    out = selection.select(_segments(spark, d), "user_id")
    return out.select("user_id", c("island").cast("long").alias("island"), _r("start_seconds"), _r("end_seconds"), "kind", _r("motion"), "zoom", "person", "windows", "movement")


def mandatory_retention(spark, d):
    """The segments that the rules keep, and one whole row for each customer without any."""
    sources = spark.read.parquet(f"{d}/customer.parquet").select(c("c_custkey").cast("long").alias("user_id"), F.lit(80.0).alias("length"), F.lit(2000).cast("long").alias("frames"))
    kept = selection.reject(_segments(spark, d)).withColumn("user_id", c("user_id").cast("long"))
    return selection.retain(sources, kept, "user_id")


def timeline_layout(spark, d):
    """W12, W13, A11 over all segments; clips have 3,000 frames."""
    return layout.layout(_segments(spark, d).withColumn("frames", F.lit(3000).cast("long")), "user_id")


def total_frames(spark, d):
    """Frames of the sequence."""
    items = timeline_layout(spark, d)
    return items.agg(F.count("*").alias("items"), F.max("file_idx").cast("long").alias("files"), F.sum(c("seq_end") - c("seq_start")).alias("frames"))


def full_run(spark, d):
    """The whole chain over all events, an event for a pair of frames and a user for a source: selects on the timeline."""
    e = windows.numbered(_events(spark, d), "user_id", *ORDER)
    move = F.element_at(F.array(*[F.lit(x) for x in ("PanTilt", "Zoom", "Roll", "Complex")]), (c("event_id") % 4 + 1).cast("int"))
    pairs = e.select(
        c("user_id").cast("string").alias("source_path"), c("i").cast("long").alias("frame_idx"), (c("value") / 40).alias("motion"), ((c("event_id") % 13) / 8).alias("zoom"), ((c("event_id") % 5) / 8).alias("rotation"),
        ((c("event_id") % 3) / 8).alias("shear"), (0.2 + (c("event_id") % 7) / 10).alias("confidence"), move.alias("movement"),
    )
    n = pairs.groupBy("source_path").agg(F.count("*").alias("n"))
    sources = n.select(
        "source_path", F.lit(1920).alias("width"), F.lit(1080).alias("height"), ((c("n") + 1) / 12).alias("duration_seconds"), F.round((c("n") + 1) / 12 * 25).cast("long").alias("duration_frames"),
        F.lit(25).cast("long").alias("timebase"), F.lit(False).alias("ntsc"), (c("source_path").cast("long") % 5 == 0).alias("slow_motion"),
    )
    chosen = run.selects(run.analyse(pairs, sources, run.Settings(motion_threshold=0.0)), sources)
    items = run.timeline(chosen, sources)
    return items.select("source_path", "item_idx", "file_idx", "full_record", "in_frame", "out_frame", "seq_start", "seq_end", "kind", "movement")


def sequence_seed(spark, d):
    clips = _events(spark, d).groupBy("user_id").agg((F.max("event_id") % 90 + 10).alias("timebase")).withColumn("slow_motion", c("user_id") % 7 == 0)
    return layout.sequence_seed(clips, "user_id")


def incremental_reuse(spark, d):
    """Sources whose stored size still fits are reused, the others are work."""
    e = _events(spark, d)
    catalog = e.groupBy("user_id").agg(F.count("*").alias("size"))
    store = catalog.where(c("user_id") % 2 == 0).select("user_id", (c("size") + F.when(c("user_id") % 10 == 0, 1).otherwise(0)).alias("size"))
    hit = catalog.join(store, ["user_id", "size"], "left_semi").withColumn("state", F.lit("reused"))
    return hit.unionByName(catalog.join(store, ["user_id", "size"], "left_anti").withColumn("state", F.lit("analyse")))


def labels(spark, d):
    s = _segments(spark, d)
    return s.select("user_id", "pos", media.label_id(c("kind")).cast("long").alias("label"), media.seconds_label(c("start_seconds")).alias("at"), media.seconds_to_frame(c("end_seconds"), F.lit(24)).alias("frame"), media.movement_label(c("kind"), c("movement")).alias("text"), media.label_colour(c("kind"), c("movement")).alias("colour"), media.clip_comment(c("kind"), c("movement"), c("start_seconds"), c("end_seconds")).alias("comment"))


def path_url(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", media.file_url(c("url")).alias("file_url"), media.cache_key(c("url")).alias("cache_key"), media.base_name(c("url")).alias("base"))


def rate_parse(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size")
    text = F.element_at(F.array(*[F.lit(x) for x in ("30000/1001", " 25 / 1 ", "0/0", "24000/1001", "60000/1001", "50/2", "x/1")]), (c("p_partkey") % 7 + 1).cast("int"))
    num, den = media.parse_rate(text)
    base, drop = media.timebase(num, den)
    tag = F.concat(F.lit('captureFps="'), c("p_size").cast("string"), F.lit('p" formatFps="25p"'))
    cap, form = media.attribute_number(tag, "captureFps"), media.attribute_number(tag, "formatFps")
    return p.select("p_partkey", num.alias("num"), den.alias("den"), base.alias("timebase"), drop.alias("ntsc"), media.duration_frames(c("p_size").cast("double"), num, den).alias("frames"), cap.alias("capture"), media.slow_motion(cap, form, num / den, F.lit(False)).alias("slow"))


#: Rows of the detector's output that stands in each vector, in turn by id: both orientations, with and without objectness, and one without attributes.
HEADS = (8, 4, 16, 11, 6, 64)


def person_head(spark, d):
    """A10: each vector, filled up with zeros, as an output tensor of one of several shapes."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    rows = F.element_at(F.array(*map(F.lit, HEADS)), (c("vec_id") % len(HEADS) + 1).cast("int"))
    wide = F.ceil(F.size("embedding") / rows).cast("int")
    filled = F.concat(c("embedding").cast("array<double>"), F.array_repeat(F.lit(0.0), rows * wide - F.size("embedding")))
    matrix = F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.slice(filled, i * wide + 1, wide))
    few = F.when(c("vec_id") % 7 == 0, F.transform(F.slice(matrix, 1, 4), lambda r: F.slice(r, 1, 4))).otherwise(matrix)  # too small a tensor
    return e.select("vec_id", F.round(media.person_score(few), 5).alias("person"))


def ext_filter(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    exts = F.lit(" .HTML, htm,,.Mov")
    return p.select("page_id", F.coalesce(media.has_extension(c("url"), media.extension_list(exts)), F.lit(False)).alias("wanted"), media.extension_key(exts).alias("exts"))


def affine_lsq(spark, d):
    """A plane fit of price by quantity and discount for each supplier, from products about the means."""
    x, y, v = c("l_quantity").cast("double"), c("l_discount").cast("double"), c("l_extendedprice").cast("double")
    l = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", x.alias("x"), y.alias("y"), v.alias("v"))  # noqa: E741
    m = lambda a, b: F.covar_pop(a, b)
    s = l.groupBy("l_suppkey").agg(F.count("*").alias("n"), m("x", "x").alias("xx"), m("y", "y").alias("yy"), m("x", "y").alias("xy"), m("x", "v").alias("xv"), m("y", "v").alias("yv"))
    det = c("xx") * c("yy") - c("xy") * c("xy")
    fit = lambda a, b, ab, av, bv: F.round((c(av) * c(b) - c(bv) * c(ab)) / det, 4)
    return s.where((c("n") > 2) & (det > 1e-9)).select("l_suppkey", "n", fit("xx", "yy", "xy", "xv", "yv").alias("ax"), fit("yy", "xx", "xy", "yv", "xv").alias("ay"))


QUERIES = (
    hop_windows, pair_delta, centre_sample, dominant_type, auto_threshold, hysteresis, smooth_isolated, merge_runs, coalesce_overlaps, trim_edges, reject_rules,
    source_selection, mandatory_retention, timeline_layout, total_frames, full_run, sequence_seed, incremental_reuse, labels, path_url, rate_parse, person_head, ext_filter, affine_lsq,
)
KEPT = f"kept AS (SELECT * FROM g WHERE {RULES})"
LAID = "y AS (SELECT *, round((end_seconds - start_seconds) * 25)::BIGINT AS dur FROM g WHERE start_frame < 3000 AND end_frame > start_frame AND round((end_seconds - start_seconds) * 25) > 0)"
NAMES = {"text": ("static", "static subject", "slow motion", "zoom", "roll", "complex camera move", "pan/tilt"), "colour": ("Cerulean", "Caribbean", "Iris", "Mango", "Lavender", "Rose", "Forest")}
NAMED = lambda k: "CASE " + " ".join(f"WHEN {w} THEN '{n}'" for w, n in zip(("kind = 'Static'", "kind = 'StaticSubject'", "kind = 'SlowMotion'", "movement = 'Zoom'", "movement = 'Roll'", "movement = 'Complex'", "true"), NAMES[k], strict=True)) + " END"
ENC = "replace(url_encode({0}), '+', '%20')"

ORACLES = {
    "hop_windows": f"WITH {NUM}, m AS (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS a FROM e) SELECT user_id, ((i - 12) // 3)::BIGINT AS window_idx, ((i - 12) // 3) * 3 / 12.0::DOUBLE AS start_seconds, ((i - 12) // 3) * 3 / 12.0::DOUBLE + 1.0 AS end_seconds, round(a, 6) AS mean_value FROM m WHERE {EMIT}",
    "pair_delta": f"WITH {NUM}, p AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY i) AS x FROM e), m AS (SELECT *, avg(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS a FROM p) SELECT user_id, ((i - 12) // 3)::BIGINT AS window_idx, round(a, 6) AS mean_delta FROM m WHERE {EMIT}",
    "centre_sample": f"WITH {NUM}, m AS (SELECT *, lag(value, 5) OVER (PARTITION BY user_id ORDER BY i) AS centre FROM e) SELECT user_id, ((i - 12) // 3)::BIGINT AS window_idx, centre FROM m WHERE {EMIT}",
    "dominant_type": f"WITH {NUM}, j AS (SELECT a.user_id, a.i, b.event_type, b.value, row_number() OVER (PARTITION BY a.user_id, a.i ORDER BY b.value DESC, b.i) AS r FROM e a JOIN e b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 11 AND a.i WHERE a.i >= 12 AND (a.i - 12) % 3 = 0) SELECT user_id, ((i - 12) // 3)::BIGINT AS window_idx, CASE WHEN value > 0 THEN event_type ELSE 'view' END AS dominant FROM j WHERE r = 1",
    "auto_threshold": "WITH b AS (SELECT user_id, least(list_sort(list(value / 10))[count(*) * 10 // 100 + 1], 1.2::DOUBLE) AS b FROM events GROUP BY 1) SELECT user_id, round(b, 6) AS baseline, round(least(greatest(1.5 * b + 0.5, 1.0), 6.0)::DOUBLE, 6) AS threshold FROM b",
    "hysteresis": f"WITH RECURSIVE {SCORED}, k AS (SELECT n.user_id, n.i, {_step('NULL::VARCHAR')} AS kind FROM s n WHERE i = 1 UNION ALL SELECT n.user_id, n.i, {_step('k.kind')} FROM k JOIN s n ON n.user_id = k.user_id AND n.i = k.i + 1) SELECT user_id, i, kind FROM k",
    "smooth_isolated": f"WITH RECURSIVE {SMOOTH} SELECT user_id, pos, kind FROM k",
    "merge_runs": f"WITH RECURSIVE {MERGE} SELECT h.user_id, r.run, min(start_seconds) AS start_seconds, last(end_seconds ORDER BY pos) AS end_seconds, min(h.kind) AS kind, round(sum(motion * windows) / sum(windows), 6) AS motion, max(zoom) AS zoom, round(sum(confidence * windows) / sum(windows), 6) AS confidence, max(person) AS person, first(movement ORDER BY -({RANK}), pos) AS movement, sum(windows)::BIGINT AS windows FROM h JOIN r USING (user_id, pos) GROUP BY h.user_id, r.run",
    "coalesce_overlaps": f"WITH {SEG}, {ISLES.replace('{src}', 'g')} SELECT user_id, island, start_seconds, end_seconds, kind, round(motion, 6) AS motion, zoom, round(confidence, 6) AS confidence, person, windows, {ISLE_MOVE} FROM co",
    "trim_edges": f"WITH {TRIM} SELECT user_id, pos, round(start_seconds, 6) AS start_seconds, round(end_seconds, 6) AS end_seconds, start_frame, end_frame FROM u",
    "reject_rules": f"WITH {SEG} SELECT user_id, pos, kind, start_seconds, end_seconds FROM g WHERE {RULES}",
    "source_selection": f"WITH {TRIM}, v AS (SELECT * FROM u WHERE {RULES}), {ISLES.replace('{src}', 'v')} SELECT user_id, island, round(start_seconds, 6) AS start_seconds, round(end_seconds, 6) AS end_seconds, kind, round(motion, 6) AS motion, zoom, person, windows, {ISLE_MOVE} FROM co",
    "mandatory_retention": f"WITH {SEG}, {KEPT} SELECT user_id::BIGINT AS user_id, start_seconds, end_seconds, start_frame, end_frame, kind FROM kept UNION ALL SELECT c_custkey::BIGINT, 0.0::DOUBLE, 80.0::DOUBLE, 0, 2000, 'Static' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM kept)",
    "timeline_layout": f"WITH {SEG}, {LAID} SELECT user_id, row_number() OVER q AS item_idx, dense_rank() OVER (ORDER BY user_id) AS file_idx, row_number() OVER (PARTITION BY user_id ORDER BY start_seconds, end_seconds) = 1 AS full_record, least(start_frame, 3000) AS in_frame, greatest(least(end_frame, 3000), least(start_frame, 3000) + 1) AS out_frame, (sum(dur) OVER q - dur)::BIGINT AS seq_start, (sum(dur) OVER q)::BIGINT AS seq_end FROM y WINDOW q AS (ORDER BY user_id, start_seconds, end_seconds ROWS UNBOUNDED PRECEDING)",
    "total_frames": f"WITH {SEG}, {LAID} SELECT count(*) AS items, count(DISTINCT user_id) AS files, sum(dur)::BIGINT AS frames FROM y",
    "sequence_seed": "SELECT user_id, max(event_id) % 90 + 10 AS timebase, user_id % 7 = 0 AS slow_motion FROM events GROUP BY user_id ORDER BY max(event_id) % 90 + 10 > 60, user_id % 7 <> 0, 2, 1 LIMIT 1",
    "incremental_reuse": "WITH k AS (SELECT user_id, count(*) AS size FROM events GROUP BY 1) SELECT user_id, size, CASE WHEN user_id % 2 = 0 AND user_id % 10 <> 0 THEN 'reused' ELSE 'analyse' END AS state FROM k",
    "labels": f"WITH {SEG} SELECT user_id, pos, CASE kind WHEN 'GimbalMove' THEN 4 WHEN 'StaticSubject' THEN 1 WHEN 'SlowMotion' THEN 5 ELSE 2 END::BIGINT AS label, printf('%02dm%02ds', start_seconds::BIGINT // 60, start_seconds::BIGINT % 60) AS at, round(end_seconds * 24)::BIGINT AS frame, {NAMED('text')} AS text, {NAMED('colour')} AS colour, 'Selects: ' || {NAMED('text')} || ' | source in ' || printf('%02dm%02ds', start_seconds::BIGINT // 60, start_seconds::BIGINT % 60) || ' out ' || printf('%02dm%02ds', round(end_seconds)::BIGINT // 60, round(end_seconds)::BIGINT % 60) || ' | duration ' || printf('%.2f', end_seconds - start_seconds) || 's' AS comment FROM g",
    "path_url": f"SELECT page_id, 'file://localhost/' || list_aggregate(list_transform(string_split(url, '/'), lambda x: {ENC.format('x')}), 'string_agg', '/') AS file_url, substr(regexp_replace(string_split(url, '/')[-1], '[^A-Za-z0-9._-]', '', 'g'), 1, 48) || '-' || substr(sha256(url), 1, 16) AS cache_key, string_split(url, '/')[-1] AS base FROM pages",
    "rate_parse": "WITH t AS (SELECT p_partkey, p_size, CASE p_partkey % 7 WHEN 0 THEN 30000 WHEN 1 THEN 25 WHEN 3 THEN 24000 WHEN 4 THEN 60000 WHEN 5 THEN 50 END::BIGINT AS num, CASE p_partkey % 7 WHEN 0 THEN 1001 WHEN 1 THEN 1 WHEN 3 THEN 1001 WHEN 4 THEN 1001 WHEN 5 THEN 2 END::BIGINT AS den FROM part) SELECT p_partkey, num, den, CASE WHEN num IS NULL THEN 1 WHEN den = 1001 THEN num // 1000 WHEN den = 1 THEN num ELSE 25 END::BIGINT AS timebase, den = 1001 AS ntsc, greatest(round(p_size::DOUBLE * num / den), 0)::BIGINT AS frames, p_size::BIGINT AS capture, p_size >= 50 AS slow FROM t",
    "person_head": """
WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e, [8, 4, 16, 11, 6, 64][vec_id % 6 + 1] AS r FROM embeddings),
w AS (SELECT *, (len(e) + r - 1) // r AS c FROM s),
o AS (SELECT *, CASE WHEN vec_id % 7 = 0 THEN least(r, 4) ELSE r END AS rows, CASE WHEN vec_id % 7 = 0 THEN least(c, 4) ELSE c END AS cols FROM w),
t AS (SELECT *, CASE WHEN rows >= 5 AND cols >= 5 THEN rows < cols ELSE rows >= 5 END AS lying FROM o),
a AS (SELECT *, CASE WHEN lying THEN rows ELSE cols END AS n, unnest(range(CASE WHEN lying THEN cols ELSE rows END)) AS k FROM t),
v AS (SELECT vec_id, n, coalesce(e[CASE WHEN lying THEN 4 * c + k ELSE k * c + 4 END + 1], 0) AS x, coalesce(e[CASE WHEN lying THEN 5 * c + k ELSE k * c + 5 END + 1], 0) AS y FROM a)
SELECT vec_id, CASE WHEN min(n) >= 5 THEN round(greatest(max(CASE WHEN n = 6 OR n >= 85 THEN x * y ELSE x END), 0), 5) END AS person FROM v GROUP BY vec_id""",
    "ext_filter": "SELECT page_id, coalesce(contains(string_split(url, '/')[-1], '.') AND lower(string_split(url, '.')[-1]) IN ('html', 'htm', 'mov'), false) AS wanted, 'htm,html,mov' AS exts FROM pages",
    "affine_lsq": "WITH l AS (SELECT l_suppkey, l_quantity::DOUBLE AS x, l_discount::DOUBLE AS y, l_extendedprice::DOUBLE AS v FROM lineitem), m AS (SELECT l_suppkey, count(*) AS n, covar_pop(x, x) AS a, covar_pop(y, y) AS b, covar_pop(x, y) AS ab, covar_pop(x, v) AS av, covar_pop(y, v) AS bv FROM l GROUP BY 1) SELECT l_suppkey, n, round((av * b - bv * ab) / (a * b - ab * ab), 4) AS ax, round((bv * a - av * ab) / (a * b - ab * ab), 4) AS ay FROM m WHERE n > 2 AND a * b - ab * ab > 1e-9",
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
