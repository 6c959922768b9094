"""Removal of repeated passages with a count-min prefilter.

A window of words is counted in the sketch under its anchor, the least hash of
the short word runs inside it. Equal windows have equal anchors at equal
offsets, so an anchor's count is never below that of a window that it stands
for, and neighbouring windows share one. Each task sketches its anchors; the
partial sketches are merged by segment. A second pass groups only windows whose
estimate is two or more, by a 128-bit key of the whole window: two 64-bit hashes
that are independent from the bytes of the words on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_bytes

WINDOW, RUN = 35, 8
#: Rows of the sketch; counters of a row lie between the two bounds, so the merged sketch has a proven size: 4 x 2**26 bits at most.
ROWS, LEAST_BITS, MOST_BITS, SEGMENT_BITS = 4, 16, 26, 16
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_BASES = (np.uint64(0x9E3779B185EBCA87), np.uint64(0xD6E8FEB86659FD93))
#: Random numbers for each byte, for two independent hashes; which bytes are blanks.
_BYTE = np.random.default_rng(35).integers(1, 2**63, (2, 256), dtype=np.uint64)
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Bytes of text that are worked on at once, and windows that a task adds up before it hands them on.
BLOCK_BYTES, MOST_WINDOWS = 1 << 20, 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _rolled(h: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A polynomial hash of each run of ``width`` word hashes, by doubling."""
    n = len(h) - width + 1
    out, done, part, size, power = None, 0, h, 1, base
    while size <= width:
        if width & size:
            piece = part[done : done + n]
            out = piece if out is None else out * power + piece
            done += size
        size <<= 1
        if size <= width:
            part = part[: len(part) - size // 2] * power + part[size // 2 :]
            power = np.multiply(*np.atleast_1d(power, power))[0]
    return _mix(out)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``width`` values, by doubling."""
    n, size = len(x) - width + 1, 1
    while 2 * size <= width:
        x = pick(x[: len(x) - size], x[size:])
        size *= 2
    return pick(x[:n], x[width - size : width - size + n])


def _blocks(batches):
    """``(rows, offsets, data)``: as many rows as fit in a block, and the bytes of their texts."""
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_BYTES, "right")) - 1)
            yield batch.slice(at, to - at), ends[at : to + 1] - ends[at], data[ends[at] : ends[to]]
            at = to


class Words:
    """The words of a block of texts: first byte, byte beyond the last, text, and a 64-bit hash each."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.data, self.texts = data, len(offsets) - 1
        filled = np.r_[False, ~_BLANK[data], False]
        starts, ends = filled[1:-1] & ~filled[:-2], filled[1:-1] & ~filled[2:]
        edge = np.unique(offsets[1:-1])
        edge = edge[(edge > 0) & (edge < len(data))]
        edge = edge[filled[edge] & filled[edge + 1]]  # a text that ends in a word meets one that begins with a word
        starts[edge], ends[edge - 1] = True, True
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.text, minlength=self.texts)

    def hashes(self, k: int = 0) -> np.ndarray:
        """The first or the second hash of each word; they share neither the numbers of the bytes nor the base."""
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        power = np.ones(int(size.max()), np.uint64)
        np.cumprod(np.full(len(power) - 1, _BASES[k]), out=power[1:])
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        parts = _BYTE[k][self.data[np.repeat(self.start, size) + at]] * power[at]
        return _mix(np.add.reduceat(parts, np.cumsum(size) - size) + size.astype(np.uint64))

    def joined(self, stay: np.ndarray) -> pa.Array:
        """The words of each text that stay, joined by single blanks."""
        kept = np.flatnonzero(stay)
        text = self.text[kept]
        gap = self.end[kept[:-1][text[1:] == text[:-1]]]  # a word that isn't a text's last is followed by a blank
        data, edge = self.data.copy(), np.zeros(len(self.data) + 1, np.int8)
        data[gap] = 32
        edge[self.start[kept]] += 1
        np.add.at(edge, self.end[kept], -1)
        take = np.cumsum(edge[:-1], dtype=np.int8) > 0
        take[gap] = True
        size = np.bincount(text, (self.end - self.start)[kept], self.texts) + np.maximum(np.bincount(text, minlength=self.texts) - 1, 0)
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), self.texts, [None, pa.py_buffer(offsets), pa.py_buffer(data[take])])


def anchors(h: np.ndarray, text: np.ndarray, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows within one text, the anchor of each, and the anchors at all places where one stands.

    A short run is an anchor if its hash is the least of some window over it:
    if it equals the greatest of the least hashes of the windows over it.
    """
    if len(h) < window:
        return np.zeros(0, np.int64), h[:0], h[:0]
    g = _rolled(h, run, _BASES[0])
    span = window - run + 1
    least = _sliding(g, span, np.minimum)
    inside = text[: len(least)] == text[window - 1 :]
    edge = np.zeros(span - 1, np.uint64)
    top = _sliding(np.concatenate([edge, np.where(inside, least, 0).astype(np.uint64), edge]), span, np.maximum)
    start = np.flatnonzero(inside)
    return start, least[start], g[(top == g) & (top > 0)]


def _slots(g: np.ndarray, bits: int) -> list[np.ndarray]:
    return [_mix(g ^ m) >> np.uint64(64 - bits) for m in _MIX[:ROWS]]


def sketch(rows: DataFrame, bits: int, window: int, run: int) -> list:
    """``(row, segment, bitmap)`` of counters that reach two over all partitions; ``rows(id, t)``."""
    seg = min(bits, SEGMENT_BITS)

    def give(found: list):
        for r, s in enumerate(_slots(np.concatenate(found), bits)):
            s = np.sort(s)
            s = s[np.r_[True, True, s[2:] != s[:-2]][: len(s)]]  # counters stop at two
            part, low = (s >> np.uint64(seg)).astype(np.int64), (s & np.uint64((1 << seg) - 1)).astype(np.uint16)
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ends = np.r_[cut[1:], len(part)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cut), r, np.int32)), pa.array(part[cut].astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())],
                names=["row", "segment", "slots"],
            )

    def count(batches):
        found, size = [], 0
        for _, offsets, data in _blocks(batches):
            words = Words(offsets, data)
            a = anchors(words.hashes(), words.text, window, run)[2]
            if len(a):
                found.append(a)
                size += len(a)
            if size > 4_000_000:
                yield from give(found)
                found, size = [], 0
        if found:
            yield from give(found)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.bincount(np.frombuffer(b"".join(pdf["slots"]), np.uint16), minlength=1 << seg)
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "segment": pdf["segment"].iloc[:1], "bitmap": [np.packbits(c >= 2, bitorder="little").tobytes()]})

    parts = rows.mapInArrow(count, "row int, segment int, slots binary")
    return parts.groupBy("row", "segment").applyInPandas(merge, "row int, segment int, bitmap binary").collect()


def _suspects(h: np.ndarray, text: np.ndarray, bitmaps: np.ndarray, bits: int, window: int, run: int) -> np.ndarray:
    """Starts of the windows whose estimated count is two or more."""
    start, least, _ = anchors(h, text, window, run)
    if not len(start):
        return start
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])  # neighbours share an anchor
    hit = np.ones(len(first), bool)
    for r, s in enumerate(_slots(least[first], bits)):
        hit &= (bitmaps[r][s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8) & 1) > 0
    return start[np.repeat(hit, np.diff(np.r_[first, len(least)]))]


def _filed(ids: pa.Array, row: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """One row for each window key of a batch of documents, and one for each document with windows that repeat within the batch."""
    order = np.argsort(a, kind="stable")
    row, at, a, b = row[order], at[order], a[order], b[order]
    head = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    many = np.diff(np.r_[np.flatnonzero(head), len(a)]) > 1
    again = np.repeat(many, np.diff(np.r_[np.flatnonzero(head), len(a)]))
    known = np.lexsort((at[again], row[again]))
    doc, start = row[again][known], at[again][known].astype("<i4")
    cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    pieces = [start[x:y].tobytes() for x, y in zip(cut, np.r_[cut[1:], len(doc)], strict=True)] if len(doc) else []
    alone, lines = ~many, int(head.sum())
    none = pa.nulls(len(pieces), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([ids.take(pa.array(row[head], mask=many)), ids.take(pa.array(doc[cut]))]),
            pa.concat_arrays([pa.array(at[head].astype(np.int32), mask=many), none]),
            pa.concat_arrays([pa.nulls(lines, pa.binary()), pa.array(pieces, pa.binary())]),
            pa.concat_arrays([pa.array(a[head]), pa.array(_mix(doc[cut].astype(np.uint64)).view(np.int64))]),
            pa.concat_arrays([pa.array(b[head]), pa.array(np.arange(len(pieces), dtype=np.int64))]),
            pa.concat_arrays([pa.array(np.where(alone, 1, 2).astype(np.int32)), pa.array(np.zeros(len(pieces), np.int32))]),
        ],
        names=["id", "start", "starts", "a", "b", "n"],
    )


def repeated_starts(rows: DataFrame, window: int = WINDOW, run: int = RUN, most_bits: int = MOST_BITS):
    """``(id, start, starts)``, lists of the windows that start at two or more places, and a function that finds windows estimated so.

    ``rows(id, t)``: ids are not null, texts are bytes. A task adds up equal
    windows of a batch before they are shuffled, so a passage that stands
    everywhere sends one row for each batch; each text is shuffled at most once.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, size / 24))), LEAST_BITS, most_bits))  # about one counter for each four words
    maps = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    step = (1 << min(bits, SEGMENT_BITS)) // 8
    for x in sketch(rows, bits, window, run):
        maps[x.row, x.segment * step : (x.segment + 1) * step] = np.frombuffer(x.bitmap, np.uint8)
    shared = spark.sparkContext.broadcast(maps)

    def flagged(batches):
        held, size = [], 0

        def give():
            base = np.cumsum([0, *(len(x[0]) for x in held[:-1])])
            parts = [np.concatenate([x[k] + (o if k == 1 else 0) for x, o in zip(held, base, strict=True)]) for k in range(1, 5)]
            return _filed(pa.concat_arrays([x[0] for x in held]), *parts)

        for batch, offsets, data in _blocks(batches):
            words = Words(offsets, data)
            h = words.hashes()
            s = _suspects(h, words.text, shared.value, bits, window, run)
            if len(s):
                text, before = words.text[s], np.cumsum(words.count) - words.count
                held.append((batch.column(0), text, s - before[text], *(_rolled(x, window, b)[s].view(np.int64) for x, b in zip((h, words.hashes(1)), _BASES, strict=True))))
                size += len(s)
            if size > MOST_WINDOWS:
                yield give()
                held, size = [], 0
        if held:
            yield give()

    windows = rows.mapInArrow(flagged, f"id {rows.schema['id'].dataType.simpleString()}, start int, starts binary, a long, b long, n int")
    total = F.sum("n").over(Window.partitionBy("a", "b"))
    hits = windows.withColumn("total", total).where("starts is not null or (start is not null and total > 1)")
    starts = hits.groupBy("id").agg(F.collect_list("start").alias("start"), F.collect_list("starts").alias("starts"))

    def candidates(words: Words) -> np.ndarray:
        """For each text whether it has such windows."""
        out = np.zeros(words.texts, bool)
        out[words.text[_suspects(words.hashes(), words.text, shared.value, bits, window, run)]] = True
        return out

    return starts, candidates


def drop_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, most_bits: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept)`` for each row: ``kept`` are the bytes of the words that stay, joined by single blanks.

    A word goes if any window over it starts at another place too, in the same
    or another document. A null text has no words. Ids may be of any type,
    null or shared: a row is known by its id and text together, and rows that
    repeat both are copies of each other. An empty table gives an empty result;
    other columns may have any names. ``most_bits`` bounds the sketch; beyond
    its capacity more windows reach the exact pass, and none is lost.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), text_bytes(text_col).alias("t"))
    key = F.struct(F.xxhash64("doc", "t").alias("a"), F.xxhash64(F.lit(window), "doc", "t").alias("b"))
    starts, candidates = repeated_starts(rows.select(key.alias("id"), "t"), window, run, most_bits)

    def result(ids: pa.Array, words: Words, stay: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        gone = np.bincount(words.text[~stay], minlength=words.texts)
        pick = pa.array(rows)
        return pa.RecordBatch.from_arrays([ids.take(pick), pa.array(words.count[rows]), pa.array(gone[rows]), words.joined(stay).take(pick)], names=["id", "n_words", "n_removed", "kept"])

    def free(batches):
        for batch, offsets, data in _blocks(batches):
            words = Words(offsets, data)
            yield result(batch.column(0), words, np.ones(len(words.start), bool), np.flatnonzero(~candidates(words)))

    def suspect(batches):
        for batch, offsets, data in _blocks(batches):
            yield batch.take(pa.array(np.flatnonzero(candidates(Words(offsets, data)))))

    def cut(batches):
        for batch, offsets, data in _blocks(batches):
            words = Words(offsets, data)
            edge, before = np.zeros(len(words.start) + 1, np.int64), np.cumsum(words.count) - words.count
            for k, (one, more) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                at = np.concatenate([np.array(one or [], np.int64), *(np.frombuffer(x, "<i4").astype(np.int64) for x in more or [])])
                at = np.unique(at[at + window <= words.count[k]]) + before[k]
                edge[at] += 1
                edge[at + window] -= 1
            yield result(batch.column(0), words, np.cumsum(edge)[:-1] == 0, np.arange(words.texts))

    schema = f"id {kind}, n_words long, n_removed long, kept binary"
    keyed = rows.select(F.col("doc").alias("id"), "t", key.alias("k"))
    rows = rows.withColumnRenamed("doc", "id")
    open_rows = keyed.mapInArrow(suspect, f"id {kind}, t binary, k struct<a: long, b: long>")  # only these texts are shuffled
    joined = open_rows.join(starts.withColumnRenamed("id", "k"), "k", "left").select("id", "t", "start", "starts")
    return rows.mapInArrow(free, schema).unionByName(joined.mapInArrow(cut, schema))


def op7_count_min_substrings(spark, sf_dir: str) -> DataFrame:
    """What stays of each document without repeated passages."""
    out = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
