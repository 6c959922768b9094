"""File catalog and probe records: S1-S6, S8-S17."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidereel.functions import media
from tidereel.operators.layout import durable

#: Folder names that are never entered. Fixed values.
SKIPPED = (".cache", ".git", "target", "node_modules", "$RECYCLE.BIN", "System Volume Information")
#: Bytes that are looked at from both ends of a file, and the mark of slow and quick motion. Fixed values.
HEAD, TAIL, MARKER = 2 << 20, 6 << 20, "slowAndQuickMotion"
#: The command that prints a file's streams and format as JSON; the path comes last. Fixed values.
PROBER = ("ffprobe", "-v", "error", "-print_format", "json", "-show_streams", "-show_format")
PROBE = "streams array<struct<codec_type:string,width:bigint,height:bigint,avg_frame_rate:string,r_frame_rate:string>>, format struct<duration:string>"


def _listed(batches):
    """Folders and files inside each folder of a batch; an entry that can't be read is left out, links aren't followed."""
    for b in batches:
        out = []
        for folder in b.column(0).to_pylist():
            try:
                entries = list(os.scandir(folder))
            except OSError:
                continue
            for e in entries:
                try:
                    if e.is_dir(follow_symlinks=False):
                        if e.name not in SKIPPED:
                            out.append((e.path, True, None, None))
                    elif e.is_file(follow_symlinks=False):
                        stat = e.stat()
                        out.append((e.path, False, max(stat.st_mtime_ns, 0), stat.st_size))
                except OSError:
                    continue
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.bool_(), pa.int64(), pa.int64()))], names=["source_path", "folder", "mtime", "length"])


def catalog(spark: SparkSession, root: str, extensions: str) -> DataFrame:
    """``(source_path, mtime, length)`` of the files below ``root``, mtime in nanoseconds; only metadata is read.

    A level of folders is a Spark job, its folders are dealt to the tasks, and
    each level is written durably. The folder must be mounted on all executors.
    Names that begin with a dot or an underscore count; excluded folders and
    what is below them don't. A root that is no folder and a list without any
    extension are errors (F10).
    """
    wanted = media.extension_list(F.lit(extensions))
    if not spark.range(1).select(F.size(wanted).alias("n")).first().n:
        raise ValueError("no file extension is given")
    if not os.path.isdir(root):
        raise ValueError(f"not a folder: {root}")
    level, files = spark.createDataFrame([(root,)], "source_path string"), None
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        found = durable(level.repartition(parts).mapInArrow(_listed, "source_path string, folder boolean, mtime long, length long"))
        own = found.where("not folder").select("source_path", "mtime", "length")
        files = own if files is None else files.unionByName(own)
        level = found.where("folder").select("source_path")
        if level.isEmpty():
            break
    return files.where(media.has_extension(F.col("source_path"), wanted))


def _added(files: DataFrame, columns: str, of: Callable[[str], tuple]) -> DataFrame:
    """``files`` with more columns that ``of(path)`` gives, where the files are; nothing is shuffled."""
    given = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema]
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[c.split()[1]] for c in columns.split(", ")]

    def run(batches):
        for b in batches:
            found = [of(p) for p in b.column(b.schema.get_field_index("source_path")).to_pylist()]
            more = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *names])

    return files.mapInArrow(run, ", ".join([*given, columns]))


def _marks(path: str) -> tuple:
    try:
        with open(path, "rb") as f:
            size = os.fstat(f.fileno()).st_size
            data = f.read() if size <= HEAD + TAIL else f.read(HEAD) + (f.seek(size - TAIL) and f.read(TAIL))
    except OSError:
        data = b""
    text = data.decode("utf-8", "replace")
    number = lambda name: (m := re.search(f'{name}="([0-9]*)', text)) and m[1] and int(m[1])
    return number("captureFps") or None, number("formatFps") or None, MARKER in text


def capture_marks(files: DataFrame) -> DataFrame:
    """Adds ``capture_fps``, ``format_fps`` and ``marked`` from the first and last bytes of each file; an unreadable one has none."""
    return _added(files, "capture_fps long, format_fps long, marked boolean", _marks)


def prober_json(files: DataFrame, prober: list[str] | tuple[str, ...] = PROBER, seconds: float = 60.0) -> DataFrame:
    """Adds ``json`` and ``prober_error``: what a prober prints for each file, run where the file is.

    ``prober`` is the command before the path. A prober that isn't there, fails
    or takes over ``seconds`` leaves an error.
    """
    command = list(prober)

    def of(path: str) -> tuple:
        try:
            done = subprocess.run([*command, path], capture_output=True, timeout=seconds, check=False)
        except (OSError, subprocess.TimeoutExpired) as e:
            return None, f"prober: {type(e).__name__}"
        if done.returncode:
            return None, f"prober: exit code {done.returncode}"
        return done.stdout.decode("utf-8", "replace"), None

    return _added(files, "json string, prober_error string", of)


def sources(spark: SparkSession, root: str, extensions: str, prober: list[str] | tuple[str, ...] = PROBER) -> DataFrame:
    """The files below ``root`` as the sources of a run: S1 to S17 in one pass over the catalog.

    ``(source_path, mtime, size, width, height, duration_seconds,
    duration_frames, fps_num, fps_den, timebase, ntsc, varies, slow_motion,
    capture_fps, format_fps, error)``; a file that can't be probed has an error.
    """
    files = prober_json(capture_marks(catalog(spark, root, extensions)), prober)
    t = probe(files)
    slow = media.slow_motion(F.col("capture_fps"), F.col("format_fps"), F.col("fps_num") / F.col("fps_den"), F.col("marked"))
    return t.select(
        "source_path", "mtime", F.col("length").alias("size"), "width", "height", "duration_seconds", "duration_frames", "fps_num", "fps_den", "timebase", "ntsc", "varies",
        F.coalesce(slow, F.lit(False)).alias("slow_motion"), "capture_fps", "format_fps", F.coalesce("prober_error", "error").alias("error"),
    )


def probe(raw: DataFrame, json: str = "json") -> DataFrame:
    """Adds the fields of the first video stream of a prober's JSON, or an ``error``; a null or broken text is an error."""
    p = F.from_json(json, PROBE)
    video = F.try_element_at(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), F.lit(1))
    num, den = media.parse_rate(F.col("v.avg_frame_rate"))
    nominal, nominal_den = media.parse_rate(F.col("v.r_frame_rate"))
    t = raw.withColumn("v", video).withColumn("duration_seconds", p["format"]["duration"].try_cast("double"))
    t = t.withColumns({"fps_num": F.coalesce(num, nominal), "fps_den": F.coalesce(den, nominal_den), "varies": F.coalesce(media.rate_varies(num, den, nominal, nominal_den), F.lit(False))})
    base, drop = media.timebase(F.col("fps_num"), F.col("fps_den"))
    problem: Column = F.when(F.col("v").isNull(), "no video stream").when(F.col("fps_num").isNull(), "no frame rate").when(F.col("duration_seconds").isNull(), "no duration")
    return t.withColumns({"width": F.col("v.width"), "height": F.col("v.height"), "timebase": base, "ntsc": drop, "duration_frames": media.duration_frames(F.col("duration_seconds"), F.col("fps_num"), F.col("fps_den")), "error": problem}).drop("v")
