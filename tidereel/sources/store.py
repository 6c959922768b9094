"""Result store and timeline export: K1-K7, S21, J1, F9, O4.

A store is a folder of data folders and one of numbered manifests. A manifest
names the data folders of a snapshot in the order of their commits, so a
reader sees all of a batch or none of it, and no file that is read is ever
written again. Batches are merged by ``compact`` and removed by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidereel.functions import media

from . import files

VERSION = 1


@dataclass(frozen=True)
class Snapshot:
    """``folders``: name, number of the commit and fingerprints of each data folder; ``streams``: the last batch number of each stream."""

    number: int = 0
    folders: tuple[dict, ...] = ()
    streams: dict[str, int] = field(default_factory=dict)


def _manifest(path: str, number: int) -> str:
    return f"{path}/_snapshots/{number:012d}.json"


def snapshots(spark: SparkSession, path: str) -> list[int]:
    return [int(n.split(".")[0]) for n in files.names(spark, f"{path}/_snapshots") if not n.startswith(".")]


def snapshot(spark: SparkSession, path: str, number: int | None = None) -> Snapshot:
    """A snapshot by its number, or the last one; without any an empty one of number 0."""
    number = number or max(snapshots(spark, path), default=0)
    if not number:
        return Snapshot()
    known = json.loads(files.read(spark, _manifest(path, number)))
    return Snapshot(known["number"], tuple(known["folders"]), known["streams"])


def _commit(spark: SparkSession, path: str, change: Callable[[Snapshot], Snapshot | None]) -> Snapshot:
    """Writes what ``change`` makes of the last snapshot under the next number, and starts again from a newer one where another writer was first; None: nothing to do."""
    while True:
        now = snapshot(spark, path)
        then = change(now)
        if then is None or files.write_new(spark, _manifest(path, then.number), json.dumps(asdict(then))):
            return then or now


def _write(rows: DataFrame, path: str) -> tuple[str, list[str]]:
    """A new data folder, not yet part of the store, and its fingerprints."""
    name, spark = uuid.uuid4().hex, rows.sparkSession
    rows.write.partitionBy("fingerprint").parquet(f"{path}/data/folder={name}")
    made = files.names(spark, f"{path}/data/folder={name}")
    return name, [unquote(m.removeprefix("fingerprint=")) for m in made if m.startswith("fingerprint=")]


def append(segments: DataFrame, path: str, stream: str | None = None, batch: int = 0, before: Callable[[], None] | None = None) -> Snapshot:
    """Whole segment rows, with ``fingerprint``; so a resumed run equals a fresh one.

    Readers see the rows from the commit on. A ``batch`` of a ``stream`` whose
    number isn't above the last one committed is there already and isn't
    written again. No rows add no folder. ``before`` is called once the rows are
    written; if it raises, nothing is committed.
    """
    spark = segments.sparkSession
    known = snapshot(spark, path).streams
    if stream is not None and known.get(stream, -1) >= batch:
        return snapshot(spark, path)
    stamp = F.current_timestamp().alias("stored_at")
    name, marks = _write(segments.select("*", F.lit(VERSION).alias("schema_version"), stamp), path)
    if before is not None:
        before()

    def change(now: Snapshot) -> Snapshot | None:
        if stream is not None and now.streams.get(stream, -1) >= batch:
            return None
        more = ({"folder": name, "commit": now.number + 1, "fingerprints": marks},) if marks else ()
        streams = now.streams if stream is None else {**now.streams, stream: batch}
        return Snapshot(now.number + 1, now.folders + more, streams) if more or stream is not None else None

    return _commit(spark, path, change)


def _rows(spark: SparkSession, path: str, folders: tuple[dict, ...], key: str, fingerprint: str | None, any_settings: bool) -> DataFrame:
    """All columns of the rows of the last commit of each source, or of each source and fingerprint."""
    read = spark.read.option("basePath", f"{path}/data").option("mergeSchema", True)
    rows = read.schema(_schema(read, path, folders)).parquet(*[f"{path}/data/folder={f['folder']}" for f in folders]).where(f"schema_version = {VERSION}")
    if fingerprint is not None:
        rows = rows.where(F.col("fingerprint") == fingerprint)
    if key not in rows.columns or len(folders) == 1 and not (any_settings and len(folders[0]["fingerprints"]) > 1):
        return rows
    rows = rows.join(spark.createDataFrame([(f["folder"], f["commit"]) for f in folders], "folder string, __commit long"), "folder")
    settings = F.lit("") if any_settings else F.col("fingerprint")
    stamp = F.struct("__commit", *(["stored_at", "fingerprint"] if any_settings else []))
    last = rows.groupBy(F.col(key).alias("__k"), settings.alias("__f")).agg(F.max(stamp).alias("__last"))
    same = F.col(key).eqNullSafe(F.col("__k")) & (settings == F.col("__f")) & (stamp == F.col("__last"))
    return rows.join(last, same, "left_semi").drop("__commit")


def _schema(read, path: str, folders: tuple[dict, ...]):
    """The columns of all folders; names of folders and fingerprints stay text, whatever they look like."""
    found = read.parquet(*[f"{path}/data/folder={f['folder']}" for f in folders]).schema
    for f in found.fields:
        if f.name in ("folder", "fingerprint"):
            f.dataType = StringType()
    return found


def load(spark: SparkSession, path: str, key: str = "source_path", any_settings: bool = False, fingerprint: str | None = None, number: int | None = None) -> DataFrame:
    """The stored rows of this version (S21, O4: in the order of ``key``, if there is one); of each source and fingerprint those of the last commit.

    ``any_settings``: of each source those of the last commit, whatever its
    fingerprint. ``fingerprint``: only folders that hold it are listed, and of
    them only its partition is read. ``number``: an older snapshot.
    """
    folders = tuple(f for f in snapshot(spark, path, number).folders if fingerprint is None or fingerprint in f["fingerprints"])
    rows = _rows(spark, path, folders, key, fingerprint, any_settings)
    return (rows.orderBy(key) if key in rows.columns else rows).drop("schema_version", "stored_at", "folder")


def compact(spark: SparkSession, path: str, key: str = "source_path", file_bytes: int = 128 << 20) -> Snapshot:
    """Merges the folders of the last snapshot into one of files of about ``file_bytes``, by ranges of fingerprint and source; rows that a later commit replaced are left out.

    Batches that are committed meanwhile stay, and stay later than the merged ones.
    """
    old = snapshot(spark, path)
    if len(old.folders) < 2:
        return old
    whole = sum(files.size(spark, f"{path}/data/folder={f['folder']}") for f in old.folders)
    rows = _rows(spark, path, old.folders, key, None, False).drop("folder")
    by = ["fingerprint", *([key] if key in rows.columns else [])]
    name, marks = _write(rows.repartitionByRange(max(1, -(-whole // file_bytes)), *by).sortWithinPartitions(*by), path)
    gone = {f["folder"] for f in old.folders}
    merged = ({"folder": name, "commit": max(f["commit"] for f in old.folders), "fingerprints": marks},)

    def change(now: Snapshot) -> Snapshot | None:
        if not gone <= {f["folder"] for f in now.folders}:
            return None  # another call has merged them
        return Snapshot(now.number + 1, merged + tuple(f for f in now.folders if f["folder"] not in gone), now.streams)

    return _commit(spark, path, change)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Removes all but the last ``keep`` snapshots, and the folders that only those held; gives the number of folders.

    Readers of a removed snapshot fail, so ``keep`` should cover those that are
    under way. A folder that no snapshot holds may belong to a writer and stays.
    """
    numbers = snapshots(spark, path)
    old, new = numbers[:-keep], numbers[-keep:]
    held = {f["folder"] for n in new for f in snapshot(spark, path, n).folders}
    gone = {f["folder"] for n in old for f in snapshot(spark, path, n).folders} - held
    for name in sorted(gone):
        files.delete(spark, f"{path}/data/folder={name}")
    for n in old:
        files.delete(spark, _manifest(path, n))
    return len(gone)


def exists(spark: SparkSession, path: str, fingerprint: str | None = None) -> bool:
    """Whether the store holds a row, of one fingerprint or of any."""
    return any(fingerprint is None or fingerprint in f["fingerprints"] for f in snapshot(spark, path).folders)


def load_or_empty(spark: SparkSession, path: str, marks, fingerprint: str | None = None) -> DataFrame:
    """``load``, or a table of the mark columns without rows where nothing has been stored."""
    return load(spark, path, fingerprint=fingerprint) if exists(spark, path, fingerprint) else spark.createDataFrame([], marks)


def split_work(catalog: DataFrame, stored: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Catalog rows that the store has under the same ``key`` (path, size, time, fingerprint), and those still to analyse."""
    known = stored.select(*key).distinct()
    return catalog.join(known, key, "left_semi"), catalog.join(known, key, "left_anti")


def _rate(timebase: int, ntsc: bool) -> str:
    return f"<rate><timebase>{timebase}</timebase><ntsc>{str(bool(ntsc)).upper()}</ntsc></rate>"


def _sample(timebase: int, ntsc: bool, width: int, height: int) -> str:
    """K5. Fixed names and values."""
    return f"<samplecharacteristics>{_rate(timebase, ntsc)}<width>{width}</width><height>{height}</height><anamorphic>FALSE</anamorphic><pixelaspectratio>square</pixelaspectratio><fielddominance>none</fielddominance></samplecharacteristics>"


def _frame(rate: str, name: str) -> tuple[str, str, str]:
    """The lines before and after the clips."""
    head = f'<xmeml version="4"><project id="project-1"><name>{escape(name)}</name><children><bin id="bin-1"><name>{escape(name)}</name><children><sequence id="sequence-1"><name>{escape(name)}</name>{rate}<media><video><track>'
    return '<?xml version="1.0" encoding="UTF-8"?>', head, "</track></video></media></sequence></children></bin></children></project></xmeml>"


#: What a clip item shows beyond its place; absent columns leave their elements out.
DETAILS = ("frames", "timebase", "ntsc", "width", "height", "label", "comment")


def _clip(r, rate: str) -> str:
    """K3: name, master, length and rate of the source, trim, place, file, label and comment, in this order."""
    has = lambda c: getattr(r, c, None) is not None
    own = _rate(r.timebase, r.ntsc) if has("timebase") else rate
    length = r.frames if has("frames") else r.out_frame - r.in_frame
    file = f'<file id="file-{r.file_idx}"' + "/>"
    if r.full_record:
        video = f"<duration>{length}</duration><media><video><duration>{length}</duration>{_sample(r.timebase, r.ntsc, r.width, r.height)}</video></media>" if has("width") else ""
        file = f'<file id="file-{r.file_idx}"><name>{escape(r.source)}</name><pathurl>{escape(r.url)}</pathurl>{own}{video}</file>'
    more = (f"<labels><label2>{escape(r.label)}</label2></labels>" if has("label") else "") + (f"<comments>{escape(r.comment)}</comments>" if has("comment") else "")
    return (
        f'<clipitem id="clipitem-{r.item_idx}"><name>{escape(r.source)}</name><masterclipid>masterclip-{r.file_idx}</masterclipid><enabled>TRUE</enabled><duration>{length}</duration>{own}'
        f"<in>{r.in_frame}</in><out>{r.out_frame}</out><start>{r.seq_start}</start><end>{r.seq_end}</end>{file}{more}</clipitem>"
    )


def text_of(spark: SparkSession, path: str) -> str:
    """A document that ``write_timeline_xml`` wrote, put together on the driver."""
    named = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value")
    return "".join(r.value for r in named.orderBy("name").toLocalIterator())


def described(items: DataFrame, path: str = "source_path") -> DataFrame:
    """Adds the name, url, label and comment of each clip item."""
    return items.withColumns({
        "source": media.base_name(F.col(path)), "url": media.file_url(F.col(path)), "label": media.label_colour(F.col("kind"), F.col("movement")),
        "comment": media.clip_comment(F.col("kind"), F.col("movement"), F.col("start_seconds"), F.col("end_seconds")),
    })


def timeline_xml(items: DataFrame, timebase: int = 25, ntsc: bool = False, name: str = "Timeline"):
    """Lines of the XML of ``layout()`` rows with ``source`` and ``url``; rows stream to the driver one partition at a time. For long timelines see ``write_timeline_xml``."""
    rate = _rate(timebase, ntsc)
    *head, foot = _frame(rate, name)
    yield from head
    for r in items.orderBy("item_idx").toLocalIterator():
        yield _clip(r, rate)
    yield foot


def write_timeline_xml(items: DataFrame, path: str, timebase: int = 25, ntsc: bool = False, name: str = "Timeline") -> None:
    """The same lines as a folder of text files, one for each range of items; joined in the order of their names they are the document."""
    rate, spark = _rate(timebase, ntsc), items.sparkSession

    def lines(batches):
        for pdf in batches:
            yield pdf[["item_idx"]].assign(value=[_clip(r, rate) for r in pdf.itertuples(index=False)])

    clips = items.select("item_idx", "file_idx", "full_record", "in_frame", "out_frame", "seq_start", "seq_end", "source", "url", *[c for c in DETAILS if c in items.columns]).mapInPandas(lines, "item_idx long, value string")
    first, head, foot = _frame(rate, name)
    ends = spark.createDataFrame([(-2, first), (-1, head), (2**63 - 1, foot)], "item_idx long, value string")
    whole = clips.unionByName(ends).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "item_idx").sortWithinPartitions("item_idx")
    whole.select(F.col("value")).write.text(path)
