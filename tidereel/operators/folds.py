"""Sequential folds over one source's windows, spread over ranges of windows.

Rows are cut into ranges of source and time, sorted, and written durably. A
source may cover many ranges, and no task reads more than its range:

- the classifier (W4) has four states, so a range is a map from state to state;
  the maps are composed by an associative scan, which gives the state in which
  each range begins;
- smoothing and merging (W5, W6) carry a run of any length; a range is folded
  from a guess, that its first source begins there, and again from the state of
  the range before, until both folds agree. Run numbers are prefix sums.

What the driver sees of a range is one or two small rows. Each fold hands on
all columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import ranged as _ranged

SLOW, MOVE, SUBJECT, STATIC = "SlowMotion", "GimbalMove", "StaticSubject", "Static"
#: Thresholds of the classifier's two states, of smoothing and of merging: fixed values.
PERSON_ENTER, PERSON_STAY = 1.0, 0.65
MOVE_ENTER, MOVE_STAY, MOVE_BREAK = (1.0, 0.20), (0.60, 0.15), (2.0, 0.40)
SLOW_ENTER, SLOW_STAY, SLOW_BREAK, SLOW_ZOOM = 0.20, 0.10, 0.40, 0.15
ZOOM_COHERENT, GAP, LEAST_SPAN = 0.55, 1.5, 1e-3


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])


def _lists(batch: pa.RecordBatch | pa.Table, names: tuple) -> list[list]:
    return [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]


def next_kind(before: str | None, motion: float, zoom: float, confidence: float, person: float, slow: bool) -> str | None:
    """Kind of a window from its scores as multiples of their thresholds and the kind of the window before."""
    present = person >= (PERSON_STAY if before == SUBJECT else PERSON_ENTER)
    enter, coherence = MOVE_STAY if before == MOVE else MOVE_BREAK if before == SUBJECT and present else MOVE_ENTER
    coherent = confidence >= coherence or zoom >= ZOOM_COHERENT
    if slow:
        bar = SLOW_STAY if before == SLOW else SLOW_BREAK if before == SUBJECT and present else SLOW_ENTER
        if (motion >= bar and coherent) or zoom >= SLOW_ZOOM:
            return SLOW
    if motion >= enter and coherent:
        return MOVE
    return SUBJECT if present else None


#: The classifier's states: the kind of the window before.
STATES = (None, SLOW, MOVE, SUBJECT)


def composed(maps: np.ndarray) -> np.ndarray:
    """Each row is a map from state to state; gives what the first up to each row do one after another, in log2(n) steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


def _range_maps(ranged: DataFrame, key: str, names: tuple) -> list:
    """For each range its first and last source and what its rows make of each state: ``(range, first, last, whole, ends)``.

    ``whole``: the range has one source only, and ``ends`` goes by the state
    before it; else all of ``ends`` is the state that the last source leaves.
    """

    def run(batches):
        place, first, last, whole, ends = None, None, None, True, [0, 1, 2, 3]
        for b in batches:
            for who, where, *row in zip(*_lists(b, (key, "__range", *names)), strict=True):
                if place is None:
                    place, first, last = where, who, who
                elif who != last:
                    last, whole, ends = who, False, [0] * 4
                after = {e: STATES.index(next_kind(STATES[e], *row)) for e in set(ends)}
                ends = [after[e] for e in ends]
        if place is not None:
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([first], kind), pa.array([last], kind), pa.array([whole]), pa.array([ends], pa.list_(pa.int32()))], names=["range", "first", "last", "whole", "ends"])

    name = ranged.schema[key].dataType.simpleString()
    kind = ranged.select(key).limit(0).toArrow().schema.field(0).type
    return sorted(ranged.select(key, "__range", *names).mapInArrow(run, f"range int, first {name}, last {name}, whole boolean, ends array<int>").collect())


def classify(windows: DataFrame, key: str, order: str, person_threshold: float = 0.42, ranges: int | None = None) -> DataFrame:
    """``windows(key, order, motion, zoom, confidence, person, threshold, slow)`` with the kind of each window, null for none.

    A null score counts as 0, a null ``slow`` as false. ``ranges``: into how
    many ranges the rows are cut; absent, the session's shuffle partitions.
    """
    norm = lambda c: F.coalesce(F.when(F.col("threshold") > 0, F.col(c) / F.col("threshold")), F.lit(0.0)).cast("double")
    person = F.coalesce(F.col("person") / person_threshold if person_threshold > 0 else F.lit(0.0), F.lit(0.0)).cast("double")
    scores = {"__m": norm("motion"), "__z": norm("zoom"), "__c": F.coalesce("confidence", F.lit(0.0)).cast("double"), "__p": person, "__s": F.coalesce("slow", F.lit(False))}
    names = tuple(scores)
    ranged = _ranged(windows.withColumns(scores), key, [order], ranges)
    maps = _range_maps(ranged, key, names)
    goes_on = [k > 0 and m.first == maps[k - 1].last for k, m in enumerate(maps)]
    after = composed(np.array([m.ends if on or not m.whole else [m.ends[0]] * 4 for m, on in zip(maps, goes_on, strict=True)]).reshape(-1, 4))
    begins = {m.range: STATES[after[k - 1][0]] for k, m in enumerate(maps) if goes_on[k]}
    shared = ranged.sparkSession.sparkContext.broadcast(begins)  # a state for each range

    def fold(batches):
        last, kind = object(), None
        for b in batches:
            out = []
            for who, where, *row in zip(*_lists(b, (key, "__range", *names)), strict=True):
                if who != last:
                    kind = shared.value.get(where) if type(last) is object else None
                kind, last = next_kind(kind, *row), who
                out.append(kind)
            kept = [k for k, n in enumerate(b.schema.names) if n not in (*names, "__range")]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(out, pa.string())], names=[*(b.schema.names[k] for k in kept), "kind"])

    return ranged.mapInArrow(fold, _schema(windows, "kind string"))


@dataclass
class _Run:
    """What smoothing and merging remember of the row before."""

    who: object = None
    kind: str | None = None
    end: float = 0.0
    since: float = 0.0
    run: int = 0

    def settle(self, row: tuple, after: tuple | None, fresh: bool) -> None:
        """Takes ``row(who, start, end, windows, kind)``, with the row that follows it."""
        who, start, end, n, own = row
        if not fresh and n == 1 and after is not None and after[0] == who:
            room = GAP * max(end - start, LEAST_SPAN)
            if self.kind == after[4] != own and abs(start - self.end) <= room and abs(after[1] - end) <= room:
                own = self.kind
        if fresh:
            self.who, self.run, self.since = who, 0, start
        else:
            span, gap = max(self.end - self.since, end - start, LEAST_SPAN), start - self.end
            if own != self.kind or not -span <= gap <= GAP * span:
                self.run, self.since = self.run + 1, start
        self.kind, self.end = own, end


_ROW = ("start_seconds", "end_seconds", "windows", "kind")


def _followed(batches, key: str, heads: dict) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches with ``(row, the row after it)`` pairs; ``heads``: the first row of the range that follows each."""
    held, rows = None, []
    for b in batches:
        found = list(zip(*_lists(b, (key, *_ROW)), strict=True))
        if found:
            if held is not None:
                yield held, list(zip(rows, [*rows[1:], found[0]], strict=True))
            held, rows = b, found
    if held is not None:
        yield held, list(zip(rows, [*rows[1:], heads.get(_lists(held.slice(0, 1), ("__range",))[0][0])], strict=True))


def _exits(ranged: DataFrame, key: str, heads, entries: dict | None) -> dict:
    """Range to ``(last source, whole, state)`` after its last row.

    Without ``entries`` the first source of each range counts as new. With
    them, only those ranges are folded, from their entry and from the guess side
    by side until the two agree; from there on there is one fold again.
    """
    shared, names = ranged.sparkSession.sparkContext.broadcast((heads, entries)), ["range", "who", "whole", "kind", "end", "since", "run"]

    def run(batches):
        following, entered = shared.value
        place, whole, state, true, begun = None, True, _Run(), None, True
        for b, pairs in _followed(batches, key, following):
            if place is None:
                place = _lists(b.slice(0, 1), ("__range",))[0][0]
                true = None if entered is None else replace(entered[place])
            for row, after in pairs:
                fresh = begun or row[0] != state.who
                whole, begun = whole and (begun or not fresh), False
                state.settle(row, after, fresh)
                if true is not None:
                    true.settle(row, after, False)
                    if (true.kind, true.since) == (state.kind, state.since):
                        state.run, true = true.run, None  # the folds agree from here on
        if place is not None:
            s = true or state
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([s.who], kind), pa.array([whole]), pa.array([s.kind], pa.string()), pa.array([s.end]), pa.array([s.since]), pa.array([s.run], pa.int64())], names=names)

    kind = ranged.select(key).limit(0).toArrow().schema.field(0).type
    seen = ranged.select(key, "__range", *(F.col(c).cast("double").alias(c) if c.endswith("seconds") else c for c in _ROW))
    if entries is not None:
        seen = seen.where(F.col("__range").isin(list(entries)))
    out = seen.mapInArrow(run, f"range int, who {ranged.schema[key].dataType.simpleString()}, whole boolean, kind string, end double, since double, run long")
    return {r["range"]: (r.who, r.whole, _Run(r.who, r.kind, r.end, r.since, r.run)) for r in out.collect()}


def _entries(ranged: DataFrame, key: str, heads: dict, firsts: dict) -> dict:
    """The state in which each range begins whose first source began before it.

    Runs are counted from 0 in each range until the states stand still; a last
    pass adds up the counts of the ranges before.
    """
    exits = _exits(ranged, key, heads, None)
    order = sorted(exits)
    goes_on = {r: before for before, r in zip(order, order[1:], strict=False) if exits[before][0] == firsts[r]}
    used: dict = {}
    while True:
        wanted = {r: replace(exits[b][2], run=0) for r, b in goes_on.items()}
        todo = {r: e for r, e in wanted.items() if exits[r][1] and used.get(r) != e}
        if not todo:
            break
        exits |= _exits(ranged, key, heads, todo)
        used |= todo
    total: dict = {}  # runs of the last source up to the end of a range
    for r in order:
        total[r] = exits[r][2].run + (total[goes_on[r]] if r in goes_on and exits[r][1] else 0)
    return {r: replace(exits[b][2], run=total[b]) for r, b in goes_on.items()}


def smooth_and_merge(segments: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """``segments(key, pos, start_seconds, end_seconds, kind, windows)`` with the smoothed kind (W5) and a run number.

    A lone window between two of one other kind takes that kind, from left to
    right. A run goes on while the kind stays and the gap fits the longer of
    the run so far and the next segment. ``ranges`` as for ``classify``. A run
    that covers many whole ranges takes a job for each of them.
    """
    ranged = _ranged(segments, key, ["start_seconds", "pos"], ranges)
    first = F.min(F.struct(F.col(key).alias("who"), F.col("start_seconds").cast("double").alias("start"), "pos", F.col("end_seconds").cast("double").alias("end"), "windows", "kind"))
    found = {r["__range"]: r.row for r in ranged.groupBy("__range").agg(first.alias("row")).collect()}  # a row for each range
    order = sorted(found)
    heads = {a: (x.who, x.start, x.end, x.windows, x.kind) for a, x in zip(order, [found[r] for r in order[1:]], strict=False)}
    entries = _entries(ranged, key, heads, {r: x.who for r, x in found.items()})
    shared = ranged.sparkSession.sparkContext.broadcast((heads, entries))

    def fold(batches):
        following, entered = shared.value
        state, begun = None, False
        for b, pairs in _followed(batches, key, following):
            if state is None:
                at = entered.get(b.column(b.schema.get_field_index("__range"))[0].as_py())
                state, begun = (_Run(), True) if at is None else (replace(at), False)
            kinds, runs = [], []
            for row, after in pairs:
                state.settle(row, after, begun or row[0] != state.who)
                begun = False
                kinds.append(state.kind)
                runs.append(state.run)
            t = b.set_column(b.schema.get_field_index("kind"), "kind", pa.array(kinds, pa.string()))
            kept = [k for k, n in enumerate(t.schema.names) if n != "__range"]
            yield pa.RecordBatch.from_arrays([*(t.column(k) for k in kept), pa.array(runs, pa.int32())], names=[*(t.schema.names[k] for k in kept), "run"])

    return ranged.mapInArrow(fold, _schema(segments, "run int"))


#: Rank of movement types for the dominant one: fixed order.
RANK = {"Subject": 5, "SlowMotion": 5, "Complex": 4, "Roll": 3, "Zoom": 2, "PanTilt": 1}


def movement_rank(c: str = "movement"):
    out = F.lit(0)
    for name, r in RANK.items():
        out = F.when(F.col(c) == name, r).otherwise(out)
    return out


def merge_runs(segments: DataFrame, key: str) -> DataFrame:
    """One row for each run (A4), with what ``selection.select`` reads.

    Frames and seconds reach from the first to the last segment; means are
    weighted by windows; zoom and person are the largest, the movement type is
    the strongest, the first of equals.
    """
    s = smooth_and_merge(segments, key)
    w, place = F.col("windows"), F.struct("start_seconds", "pos")
    return s.groupBy(key, "run").agg(
        F.min("start_seconds").alias("start_seconds"),
        F.max_by("end_seconds", place).alias("end_seconds"),
        F.min_by("start_frame", place).alias("start_frame"),
        F.max_by("end_frame", place).alias("end_frame"),
        F.min("pos").alias("pos"),
        F.first("kind").alias("kind"),
        (F.sum(F.col("motion") * w) / F.sum(w)).alias("motion"),
        F.max("zoom").alias("zoom"),
        (F.sum(F.col("confidence") * w) / F.sum(w)).alias("confidence"),
        F.max("person").alias("person"),
        F.min_by("movement", F.struct(-movement_rank(), "start_seconds", "pos")).alias("movement"),
        F.sum(w).alias("windows"),
        *[F.max(c).alias(c) for c in ("length",) if c in segments.columns],
    )
