"""Token ids in files: range asymmetric numeral system chunks in a Parquet folder, in ascending order of the ids of the documents.

1. Documents are dealt by ranges of their id, so that a range's text fits a
   task; the texts are shuffled once, and only ids reach the driver as bounds.
2. A task encodes its documents in order and writes chunks of whole documents:
   a frequency table that the chunk's blocks share, and the blocks (``rans``).
3. A manifest has the tokens of each range before it, from one sum for each
   range. A chunk knows its place in the range, so a reader finds the place of
   each document in the whole without reading any other chunk.

A chunk is a row: any task can read it, all its blocks and all stretches
between checkpoints are decoded at once, and a lost task is run again alone.
"""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .common import _shared, partitions

#: Tokens of a block (a longer document is a block of its own) and of a chunk.
BLOCK_TOKENS, CHUNK_TOKENS = 1 << 16, 1 << 22
#: Bytes of text that a range has on average at most; pieces that a Python worker remembers; characters encoded at once, so that a word
#: of many texts is cut once; tokens handed on at once.
RANGE_BYTES, MEMO_WORDS, ENCODE_CHARS, READ_TOKENS = 64 << 20, 400_000, 8_000_000, 2_000_000
#: Pieces of a byte-level vocabulary: fixed by the tokenizers library.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blanks by Unicode's White_Space property: fixed values.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A text with a blank before a space, or a space at an end, isn't cut at its spaces.
_ODD = f"[{BLANKS}] |^ | $"


def _listed(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


@contextmanager
def _uncollected():
    """No search for cycles: hundreds of thousands of live lists make it cost as much as the encoding, and none is in a cycle."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Encoder:
    """What ``tokenizers`` gives for whole texts.

    A piece never holds a blank after another character, so a text may be cut
    before any single space. The words of many texts are cut and told apart by
    Arrow; distinct ones are cut into pieces together, and the library's model
    gives the ids of the pieces that aren't remembered.
    """

    def __init__(self, definition: str, memo_words: int = MEMO_WORDS):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_str(definition)
        if not isinstance(whole.pre_tokenizer, pre_tokenizers.ByteLevel) or whole.normalizer is not None or whole.pre_tokenizer.add_prefix_space:
            raise ValueError("a byte-level vocabulary without prefix blank or normalizer is asked for")
        self.kind = "<u2" if whole.get_vocab_size() <= 1 << 16 else "<u4"
        self.tokenize, self.find, self.most = whole.model.tokenize, regex.compile(PIECES).findall, memo_words
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others are lifted, in order
        rest = iter(range(256, 512))
        self.letters = {b: chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)}
        self.memo: dict[str, bytes] = {}

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece; the memo keeps its first half when it is full: those are the frequent ones."""
        memo, size = self.memo, np.dtype(self.kind).itemsize
        out = list(map(memo.get, pieces))
        fresh = list(dict.fromkeys(p for p, x in zip(pieces, out, strict=True) if x is None))
        if fresh:
            shown = "\n".join(fresh).encode().decode("latin-1").translate(self.letters).split(self.letters[10]) if not any("\n" in p for p in fresh) else [p.encode().decode("latin-1").translate(self.letters) for p in fresh]
            got = [self.tokenize(p) for p in shown]
            flat, ends = np.array([t.id for g in got for t in g], self.kind).tobytes(), np.cumsum([len(g) * size for g in got]).tolist()
            for p, a, b in zip(fresh, [0, *ends], ends, strict=False):
                memo[p] = flat[a:b]
            out = [memo[p] if x is None else x for p, x in zip(pieces, out, strict=True)]
        if len(memo) > self.most:
            for k in list(islice(memo, self.most // 2, None)):
                del memo[k]
        return out

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of each distinct word, a space before it."""
        texts = _listed(words)
        pieces = pa.array(self.find(" " + " ".join(texts) if texts else ""), pa.string()).dictionary_encode()
        ids = pa.array(self._ids(_listed(pieces.dictionary)), pa.binary()).take(pieces.indices)
        lengths = pc.utf8_length(pieces.dictionary).to_numpy(zero_copy_only=False)[pieces.indices.to_numpy(zero_copy_only=False)]
        ends = np.searchsorted(np.cumsum(lengths), np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1), "right")
        places = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1)[np.r_[0, ends]]
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(places.astype(np.int32)), ids.buffers()[2]])

    def _each(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, all their pieces looked up together."""
        cut = list(map(self.find, texts))
        ids = iter(self._ids([p for pieces in cut for p in pieces]))
        return [b"".join(islice(ids, len(pieces))) for pieces in cut]

    @_uncollected()
    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd))
        cut = pc.split_pattern(plain, " ")
        ends, words = cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py(), cut.flatten()
        first = np.r_[0, ends].astype(np.int64)[: len(plain)]
        head = self._each(_listed(words.take(pa.array(first))))
        rest = np.ones(len(words), bool)
        rest[first] = False
        told = words.filter(pa.array(rest)).dictionary_encode()
        ids = self._words(told.dictionary).take(told.indices)
        places, data = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1) if len(ids) else np.zeros(1, np.int32), ids.buffers()[2]
        data = memoryview(data) if data is not None else b""
        tail = places[np.r_[0, ends - np.arange(1, len(plain) + 1)]]
        parts = iter([h + bytes(data[a:b]) for h, a, b in zip(head, tail[:-1].tolist(), tail[1:].tolist(), strict=True)])
        whole = iter(self._each(_listed(texts.filter(pa.array(odd)))))
        return [np.frombuffer(next(whole) if o else next(parts), self.kind) for o in odd.tolist()]


@lru_cache(maxsize=2)
def encoder_of(definition: str, memo_words: int) -> Encoder:
    return Encoder(definition, memo_words)


def _chunks(batches, encode, kind: str, end: int, block_tokens: int, chunk_tokens: int):
    """Chunks of ``(id, text)`` batches, in order; a chunk closes when it has its tokens, so a task holds no more than one."""
    part, first, seq = TaskContext.get().partitionId(), 0, 0
    ids, lengths, blocks, block, size, open_size = [], [], [], [], 0, 0

    def chunk():
        if block:
            blocks.append(np.concatenate(block))
        counts = pa.array(lengths, pa.int32())
        row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64())]
        listed = [pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), x) for x in (pa.concat_arrays(ids), counts)]
        return pa.RecordBatch.from_arrays([*row, *listed, pa.array([rans.encode(blocks)], pa.binary())], names=["part", "seq", "first", "tokens", "ids", "lengths", "chunk"])

    stop = np.array([end], kind)
    for batch in batches:
        step = max(1, int(batch.num_rows * ENCODE_CHARS / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            piece, low = batch.slice(at, step), 0
            for k, x in enumerate(encode(piece.column(1))):
                block += [x, stop]
                lengths.append(len(x) + 1)
                open_size += len(x) + 1
                if open_size >= block_tokens:
                    blocks.append(np.concatenate(block))
                    size, block, open_size = size + open_size, [], 0
                if size + open_size >= chunk_tokens:
                    ids.append(piece.column(0).slice(low, k + 1 - low))
                    size += open_size
                    yield chunk()
                    first, seq, low = first + size, seq + 1, k + 1
                    ids, lengths, blocks, block, size, open_size = [], [], [], [], 0, 0
            ids.append(piece.column(0).slice(low))
    if lengths:
        size += open_size
        yield chunk()


def write_tokens(docs: DataFrame, path: str, definition: str, end: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, chunk_tokens: int = CHUNK_TOKENS, memo_words: int = MEMO_WORDS) -> None:
    """Writes the ids of each text, and ``end`` after each, to the folders ``chunks`` and ``manifest`` below ``path``.

    ``definition`` is the text of a tokenizer's JSON file; strings of special
    tokens are ordinary text. Rows come in ascending order of the id, a null id
    first; rows of one id in the order of a hash of the text, so a crowded id
    spreads over tasks. A null text is an empty one: its end only. An empty
    table gives empty files. Long texts are whole; other columns may have any
    names.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts, kind = max(partitions(docs), -(-size // RANGE_BYTES)), docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(definition)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(parts, F.col("id").asc_nulls_first(), "h", "row").sortWithinPartitions(F.col("id").asc_nulls_first(), "h", "row")

    def run(batches):
        encoder = encoder_of(shared.value, memo_words)  # a worker keeps it for its next task
        yield from _chunks(batches, encoder.encode, encoder.kind, end, block_tokens, chunk_tokens)

    out = rows.select("id", "t").mapInArrow(run, f"part int, seq int, first long, tokens long, ids array<{kind}>, lengths array<int>, chunk binary")
    sizes = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}  # a few chunks a row group, so that many tasks read a file
    out.write.options(**sizes).parquet(f"{path}/chunks")
    whole = spark.read.parquet(f"{path}/chunks").groupBy("part").agg(F.sum("tokens").alias("tokens"))
    spark_sum = F.expr("sum(tokens) over (order by part rows between unbounded preceding and 1 preceding)")  # a row for each range
    whole.select("part", F.coalesce(spark_sum, F.lit(0)).alias("start")).coalesce(1).write.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, n_tokens, ids)`` of each document of a folder that ``write_tokens`` wrote; ids are little-endian 32-bit integers.

    A chunk is decoded where it is read; the manifest, some 12 bytes for each
    range of ``RANGE_BYTES`` of text, goes to all tasks.
    """
    chunks = spark.read.parquet(f"{path}/chunks").join(F.broadcast(spark.read.parquet(f"{path}/manifest")), "part")
    kind = dict(chunks.dtypes)["ids"].removeprefix("array<").removesuffix(">")

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                ids, length, data, start = (b.column(c)[k] for c in range(4))
                ids, length = ids.values, length.values.to_numpy().astype(np.int64)
                flat, ends = np.concatenate(rans.decode(data.as_buffer().to_pybytes())), np.cumsum(length)
                if ends[-1] != len(flat):
                    raise ValueError("a chunk's lengths don't fit its ids")
                starts = start.as_py() + ends - length
                step = max(1, len(length) * READ_TOKENS // len(flat))
                for at in range(0, len(length), step):
                    own = slice(at, at + step)
                    lo, hi = int((ends - length)[at]), int(ends[own][-1])
                    places = np.r_[0, np.cumsum(length[own])] * 4
                    body = pa.Array.from_buffers(pa.binary(), len(length[own]), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(flat[lo:hi].astype("<u4").tobytes())])
                    yield pa.RecordBatch.from_arrays([ids.slice(at, step), pa.array(starts[own]), pa.array(length[own]), body], names=["id", "start", "n_tokens", "ids"])

    return chunks.select("ids", "lengths", "chunk", (F.col("start") + F.col("first")).alias("at")).mapInArrow(run, f"id {kind}, start long, n_tokens long, ids binary")


def vocabulary() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op13_rans_files(spark, sf_dir: str) -> DataFrame:
    """Place, number and checksum of each document's ids, read back from the files."""
    path = f"{_shared(spark)}/tokens-{uuid.uuid4()}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary(), end=2)
    return read_tokens(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
