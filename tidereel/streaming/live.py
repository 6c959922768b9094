"""Live frame streams: the windows of sources whose frames are still coming in.

The state of a source is its last thumbnail, the pairs of one window, the kind
of the window before and the frames that came too early; it doesn't grow with
the length of the source. A timer ends a source that no frame has come for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidereel.functions import motion
from tidereel.operators import folds, windows
from tidereel.plans.settings import Settings
from tidereel.sources import frames

#: State store that the operator needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: ``event``: ``window``, or ``end`` with the source's last frame as ``frame_idx`` and its frames that came too late as ``late``.
OUT = "source_path string, event string, window_idx long, start_seconds double, end_seconds double, motion double, zoom double, rotation double, shear double, confidence double, movement string, kind string, frame_idx long, late long"
_NAMES = [c.split()[0] for c in OUT.split(", ")]
#: Plain objects for strings: several frames with chunked strings can't be put into one batch.
_TYPES = {name: {"string": "object", "long": "Int64", "double": "float64"}[kind] for name, kind in (c.split() for c in OUT.split(", "))}
_SCORES = ("motion", "zoom", "rotation", "shear", "confidence")
_FRAME = "width int, height int, luma binary"
_PAIR = "frame_idx long, motion double, zoom double, rotation double, shear double, confidence double, movement string"


def _speaks(pair: tuple) -> float | None:
    """P25 for one pair."""
    _, moved, zoom, rotation, shear, _, movement = pair
    if movement == "Zoom":
        return zoom
    if movement == "Roll":
        return rotation
    if movement == "Complex":
        return max((x for x in (shear, rotation) if x is not None), default=None)
    return moved


class Windows(StatefulProcessor):
    """Frames of one source to its windows, in the order of their numbers."""

    def __init__(self, settings: Settings, idle_seconds: float, patience: int, slow: bool):
        self.rows, self.step = windows.geometry(settings.fps, settings.window_seconds)
        self.settings, self.idle_ms, self.patience, self.slow = settings, int(idle_seconds * 1000), patience, slow

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"frame_idx long, {_FRAME}")
        self.told = handle.getValueState("told", "kind string, late long")
        self.ring = handle.getListState("ring", _PAIR)
        self.early = handle.getMapState("early", "frame_idx long", _FRAME)

    def _window(self, pairs: list[tuple], at: int, before: str | None) -> dict:
        rate, k = self.settings.fps / motion.BASE_FPS, (at + 1 - self.rows) // self.step
        means = {}
        for i, name in enumerate(_SCORES, 1):
            known = [p[i] for p in pairs if p[i] is not None]
            means[name] = (sum(known) / len(known) if known else 0.0) * (1.0 if name == "confidence" else rate)
        loud = [(-s, p[0], p[6]) for p in pairs if (s := _speaks(p)) is not None]
        movement = min(loud)[2] if loud and min(loud)[0] < 0 else "PanTilt"
        bar = self.settings.motion_threshold
        kind = folds.next_kind(before, means["motion"] / bar, means["zoom"] / bar, means["confidence"], 0.0, self.slow)
        start = k * self.step / self.settings.fps
        return {"event": "window", "window_idx": k, "start_seconds": start, "end_seconds": start + self.settings.window_seconds, **means, "movement": movement, "kind": kind, "frame_idx": at}

    def _advance(self, key: tuple, came: dict[int, tuple], ending: bool) -> list[dict]:
        """Takes ``came``, frame number to frame, as far as numbers follow one another or patience runs out."""
        last = tuple(self.last.get()) if self.last.exists() else None
        before, late = tuple(self.told.get()) if self.told.exists() else (None, 0)
        pairs, out = [tuple(p) for p in self.ring.get()] if self.ring.exists() else [], []
        waiting = {k[0]: tuple(v) for k, v in self.early.iterator()} if self.early.exists() else {}
        held = set(waiting)
        for n, frame in came.items():
            if last is not None and n <= last[0]:
                late += 1
            else:
                waiting.setdefault(n, frame)
        newest = max(waiting, default=0)
        for n in sorted(waiting):
            expected = 0 if last is None else last[0] + 1
            if n > expected and not ending and newest - n < self.patience:
                break  # the frames between may still come
            frame = waiting.pop(n)
            if last is not None and n == expected:
                found = None
                if frame[2] is not None and last[3] is not None:
                    sizes = [motion.thumbnail_size(w, h) for w, h in (last[1:3], frame[:2])]
                    a, b = (np.frombuffer(x, np.uint8).reshape(h, w) for x, (w, h) in zip((last[3], frame[2]), sizes, strict=True))
                    found = motion.pair_motion(a, b, motion.source_scale(*frame[:2]))
                pairs = [p for p in pairs if p[0] > n - self.rows + 1]
                pairs.append((n, *((found[c] for c in (*_SCORES, "movement")) if found else [None] * 6)))
                if n + 1 >= self.rows and (n + 1 - self.rows) % self.step == 0:
                    out.append(self._window(pairs, n, before))
                    before = out[-1]["kind"]
            last = (n, *frame)
        if ending:
            out.append({"event": "end", "frame_idx": last[0] if last else None, "late": late})
            for s in (self.last, self.told, self.ring, self.early):
                s.clear()
        else:
            if last is not None:
                self.last.update(last)
            self.told.update((before, late))
            if pairs:
                self.ring.put(pairs)
            for n in held - set(waiting):
                self.early.removeKey((n,))
            for n in set(waiting) - held:
                self.early.updateValue((n,), waiting[n])
        return [{"source_path": key[0], **row} for row in out]

    def _frame(self, rows: list[dict]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=_NAMES).astype(_TYPES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            # the best of equal numbers is whole; then the smallest bytes, so that a cut between them matters least
            came: dict[int, tuple] = {}
            for n, w, h, luma in zip(pdf["frame_idx"], pdf["width"], pdf["height"], pdf["luma"], strict=True):
                frame = (None if pd.isna(w) else int(w), None if pd.isna(h) else int(h), None if luma is None else bytes(luma))
                came[int(n)] = min(came.get(int(n), frame), frame, key=lambda f: (f[2] is None, f[2] or b""))
            yield from self._frame(self._advance(key, came, False))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._frame(self._advance(key, {}, True))

    def close(self) -> None:
        pass


def live_windows(stream: DataFrame, settings: Settings, idle_seconds: float = 60.0, patience: int = 64, slow: bool = False) -> DataFrame:
    """A stream ``frames(source_path, frame_idx, width, height, pixels)`` to one row for each window, and one at the end of a source.

    Windows have the scores and kinds that ``run.window_scores`` and
    ``folds.classify`` give for the whole source, however the stream is cut
    into micro-batches. Frames are numbered from 0. One that comes early waits
    until those before it are there or a frame ``patience`` numbers beyond it
    has come; one that comes after its place was passed isn't used and is
    counted in ``late`` of the source's last row. Repeated numbers within a
    micro-batch count once. After ``idle_seconds`` without a frame a source
    ends: what still waits is used, and its state goes. Frames without a source
    or number are left out; broken ones give null scores and keep their place.

    Thumbnails are made before the shuffle. A threshold that is found from all
    of a source's scores (A3) can't be known while it runs, so the settings
    must name one above 0. The session must use a state store with several
    states to a key: set ``spark.sql.streaming.stateStore.providerClass`` to ``STORE``.
    Since timers must run, batches without data go on until the query is
    stopped: ``availableNow`` doesn't end.
    """
    if settings.motion_threshold <= 0:
        raise ValueError("a live stream needs a motion_threshold above 0")
    if settings.detector:
        raise ValueError("a live stream has no detector scores")
    keyed = frames.thumbnails(stream).groupBy("source_path")
    return keyed.transformWithStateInPandas(Windows(settings, idle_seconds, patience, slow), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")
