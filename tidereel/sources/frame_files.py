"""Frames of packed BGR24 files as a Python data source: S18, S19, S20.

A file holds frames of ``width * height * 3`` bytes, one after another, as a
decoder leaves them. Scaling and the frame rate are arguments of the source, so
a task reads only the frames that the result keeps, and of a long file only its
own range::

    spark.dataSource.register(FrameFiles)
    spark.read.format("packed_frames").option("path", folder).option("height", 360).option("fps", 12).load()

Options: ``path`` (a file, a folder, or several joined by new lines);
``height`` and ``fps`` of the result (absent: as stored); ``stored``: geometry
``WIDTHxHEIGHT@RATE`` of files whose names don't end in ``_WIDTHxHEIGHT@RATE``
before the extension; ``extension`` (``bgr24``); ``task_bytes``: bytes that a
task reads at most; ``pushdown``: ``true`` where the session has
``spark.sql.python.filterPushdown.enabled``, so that filters on
``source_path`` and ``frame_idx`` choose files and ranges. Spark 4.1 keeps what
one query pushed for later queries of the same frame, so load anew for each.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidereel.plans.settings import even_width

SCHEMA = "source_path string, frame_idx long, width int, height int, pixels binary, error string"
_GEOMETRY = re.compile(r"(\d+)x(\d+)@(\d+(?:\.\d+)?)")
#: Bytes of frames in one batch.
BATCH_BYTES = 8 << 20
_TYPES = pa.schema([("source_path", pa.string()), ("frame_idx", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])


@dataclass(frozen=True)
class Geometry:
    """Stored width, height and rate, and the wanted height and rate."""

    width: int
    height: int
    rate: float
    to_height: int | None = None
    fps: float | None = None

    @property
    def frame_bytes(self) -> int:
        return self.width * self.height * 3

    @property
    def shape(self) -> tuple[int, int]:
        """Width and height of a frame of the result."""
        if self.to_height is None or self.to_height == self.height:
            return self.width, self.height
        return even_width(self.width, self.height, self.to_height), self.to_height

    def stored_index(self, k: int) -> int:
        """The stored frame that is on screen at the time of frame ``k`` of the result."""
        return k if self.fps is None else int(k * self.rate / self.fps + 1e-9)

    def frames(self, stored: int) -> int:
        """Frames of the result from so many whole stored ones."""
        if self.fps is None:
            return stored
        n = max(int(stored * self.fps / self.rate) - 1, 0)
        while self.stored_index(n) < stored:
            n += 1
        return n

    def scaled(self, pixels: bytes) -> bytes:
        """Nearest source pixels; the reader of a frame never works out its width again."""
        w, h = self.shape
        if (w, h) == (self.width, self.height):
            return pixels
        frame = np.frombuffer(pixels, np.uint8).reshape(self.height, self.width, 3)
        return frame[(np.arange(h) * self.height // h)[:, None], np.arange(w) * self.width // w].tobytes()


@dataclass
class Piece(InputPartition):
    """Frames of the result from ``first`` up to below ``last``, or why there are none."""

    path: str
    geometry: Geometry | None
    first: int
    last: int
    error: str | None = None


def geometry_of(path: str, stored: str | None, height: int | None, fps: float | None) -> Geometry:
    found = re.search(rf"_{_GEOMETRY.pattern}\.[^./]*$", path) or _GEOMETRY.fullmatch(stored or "")
    if not found or min(int(found[1]), int(found[2])) < 1 or float(found[3]) <= 0:
        raise ValueError("no frame size and rate are known")
    return Geometry(int(found[1]), int(found[2]), float(found[3]), height, fps)


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split("\n") if p]
        self.extension, self.stored = options.get("extension", "bgr24").lower(), options.get("stored")
        self.height = int(options["height"]) if "height" in options else None
        self.fps = float(options["fps"]) if "fps" in options else None
        self.task_bytes = int(options.get("task_bytes", 128 << 20))
        if not self.paths or (self.height is not None and self.height < 1) or (self.fps is not None and self.fps <= 0) or self.task_bytes < 1:
            raise ValueError("a path is needed, and height, fps and task_bytes above 0")
        self.only: set[str] | None = None
        self.low, self.high = 0, None

    def files(self) -> Iterator[str]:
        for path in self.paths:
            if os.path.isdir(path):
                for folder, inner, names in os.walk(path):
                    inner.sort()
                    yield from (os.path.join(folder, n) for n in sorted(names) if n.lower().endswith(f".{self.extension}"))
            else:
                yield path  # a path that isn't there gives an error row, as any file that can't be read

    def partitions(self) -> list[Piece]:
        out = []
        for path in self.files():
            if self.only is not None and path not in self.only:
                continue
            try:
                g = geometry_of(path, self.stored, self.height, self.fps)
                n = g.frames(os.path.getsize(path) // g.frame_bytes)  # a short last frame is no frame
                if n == 0:
                    raise ValueError("no whole frame")
            except (OSError, ValueError) as e:
                out.append(Piece(path, None, 0, 0, e.strerror if isinstance(e, OSError) else str(e)))
                continue
            each = max(1, self.task_bytes // g.frame_bytes)
            last = n if self.high is None else min(n, self.high)
            out += [Piece(path, g, k, min(k + each, last)) for k in range(max(self.low, 0), last, each)]
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece.error is not None:
            yield _batch([(piece.path, None, None, None, None, piece.error)])
            return
        g, rows, size = piece.geometry, [], 0
        (w, h), at, pixels = g.shape, None, b""
        try:
            with open(piece.path, "rb", buffering=0) as f:
                for k in range(piece.first, piece.last):
                    index = g.stored_index(k)
                    if index != at:
                        f.seek(index * g.frame_bytes)
                        at, data = index, f.read(g.frame_bytes)
                        if len(data) < g.frame_bytes:
                            raise OSError(0, "the file became shorter")
                        pixels = g.scaled(data)
                    rows.append((piece.path, k, w, h, pixels, None))
                    size += len(pixels)
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        except OSError as e:
            rows.append((piece.path, None, None, None, None, e.strerror))
        if rows:
            yield _batch(rows)


class PushingReader(FrameReader):
    def pushFilters(self, filters: list[Filter]):
        """Bounds of ``frame_idx`` and choices of ``source_path`` decide what is planned; Spark still checks every row."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("source_path",) and isinstance(f, EqualTo | In):
                chosen = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = chosen if self.only is None else self.only & chosen
            elif column == ("frame_idx",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                v = int(f.value)
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, v + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    top = v + (not isinstance(f, LessThan))
                    self.high = top if self.high is None else min(self.high, top)
            yield f


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES.types, strict=True)], schema=_TYPES)


class FrameFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        pushing = self.options.get("pushdown", "false").lower() == "true"
        return (PushingReader if pushing else FrameReader)(self.options)


def read_frames(spark: SparkSession, *paths: str, height: int | None = None, fps: float | None = None, **options) -> DataFrame:
    """``(source_path, frame_idx, width, height, pixels, error)`` of packed files.

    A file that can't be read, has no whole frame or no known geometry gives
    one row with an ``error`` and no frame. The files must be mounted on all
    executors.
    """
    spark.dataSource.register(FrameFiles)
    given = {"path": "\n".join(paths), "height": height, "fps": fps, **options}
    return spark.read.format("packed_frames").options(**{k: v for k, v in given.items() if v is not None}).load()
