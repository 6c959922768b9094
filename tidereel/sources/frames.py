"""Frame tables to motion scores of successive frames: J4, V1."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidereel.functions import motion

PAIRS = "source_path string, frame_idx long, motion double, zoom double, rotation double, shear double, confidence double, movement string"
_NAMES = [c.split()[0] for c in PAIRS.split(", ")]


def thumbnails(frames: DataFrame) -> DataFrame:
    """``frames(source_path, frame_idx, width, height, pixels)`` to ``(source_path, frame_idx, width, height, luma)``.

    ``pixels`` are BGR triples or brightness bytes. A frame with nulls or of a
    wrong length keeps its row with a null ``luma``; rows without a source or a
    frame number are left out. This runs where the frames are read, so full
    frames never enter a shuffle.
    """

    def run(batches):
        for b in batches:
            luma = []
            for w, h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
                size = len(p.as_buffer()) if p.is_valid else 0
                whole = w is not None and h is not None and min(w, h) > 0 and size in (w * h, w * h * 3)
                luma.append(motion.thumbnail(np.frombuffer(p.as_buffer(), np.uint8).reshape((h, w) if size == w * h else (h, w, 3))).tobytes() if whole else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(luma, pa.binary())], names=["source_path", "frame_idx", "width", "height", "luma"])

    known = frames.where("source_path is not null and frame_idx is not null")
    return known.select("source_path", "frame_idx", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels").mapInArrow(run, "source_path string, frame_idx long, width int, height int, luma binary")


def pair_scores(frames: DataFrame, chunk: int = 512) -> DataFrame:
    """``frames(source_path, frame_idx, width, height, pixels)`` to one row for each frame and the one before it.

    Thumbnails are compared, shifts are counted in source pixels. Sources are
    cut into chunks of frames, so a long clip spreads over many tasks; the last
    frame of a chunk also goes to the next one. A first frame gives no row; a
    pair that can't be compared, because a frame is broken or of another size,
    has null scores and keeps its place.
    """
    part = F.floor(F.col("frame_idx") / chunk)
    rows = thumbnails(frames).select("*", F.explode(F.when(F.col("frame_idx") % chunk == chunk - 1, F.array(part, part + 1)).otherwise(F.array(part))).alias("part"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, last = [], None
        for r in pdf.sort_values("frame_idx").itertuples():
            now = None
            if r.luma is not None:
                w, h = motion.thumbnail_size(int(r.width), int(r.height))
                now = np.frombuffer(r.luma, np.uint8).reshape(h, w)
            if last is not None and r.frame_idx == last[0] + 1:
                found = None if now is None or last[1] is None else motion.pair_motion(last[1], now, motion.source_scale(r.width, r.height))
                out.append({"source_path": r.source_path, "frame_idx": r.frame_idx, **(found or dict.fromkeys(_NAMES[2:]))})
            last = (r.frame_idx, now)
        return pd.DataFrame(out, columns=_NAMES)

    return rows.groupBy("source_path", "part").applyInPandas(run, PAIRS)
