"""Byte-level BPE by corpus-level merge replay.

A block of documents is cut into pieces; the distinct pieces that were not met
before form the corpus of the replay. An inverted index leads from the rank of
a token pair to the positions where it stands in any of these words. Ranks are
taken in ascending order from a heap; a merge touches only the two neighbours
of its position and files the two new pairs. Spark deals the documents out, so
a task replays the words of its own share and remembers a bounded number.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a Python worker remembers at most, and characters of a block of documents.
MEMO_WORDS, BLOCK_CHARS = 400_000, 1_000_000


class MergeReplay:
    """Encodes many words at once. ``ranks``: token bytes to rank; the rank is the token's id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab = [b for _, b in sorted((r, b) for b, r in ranks.items())] if sorted(ranks.values()) == list(range(len(ranks))) else {r: b for b, r in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.two = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.known: dict[int, int] = {}
        self.most = 500_000  # pairs that are remembered

    def _rank(self, key: int) -> int:
        """The rank at which the two tokens ``key >> 32`` and ``key & 0xffffffff`` merge, -1 if never."""
        if len(self.known) > self.most:
            self.known.clear()
        r = self.known[key] = self.ranks.get(self.vocab[key >> 32] + self.vocab[key & 0xFFFFFFFF], -1)
        return r

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; a word that is itself a token is that token."""
        ranks, single, two, lookup, learn = self.ranks, self.single, self.two, self.known.get, self._rank
        out: list = []
        ids: list[int] = []
        owner: list[int] = []
        rank: list[int] = []  # of the pair that begins at a position
        spans = []
        for k, w in enumerate(words):
            if (whole := ranks.get(w)) is not None:
                out.append([whole])
                continue
            out.append([])
            if w:
                spans.append((k, len(ids), len(ids) + len(w)))
                ids += [single[b] for b in w]
                owner += [k] * len(w)
                rank += [two[a << 8 | b] for a, b in zip(w, w[1:], strict=False)]
                rank.append(-1)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        for _, p, end in spans:
            after[end - 1] = before[p] = -1
        index: dict[int, list[int]] = {}
        for p, r in enumerate(rank):
            if r >= 0:
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            held: set[int] = set()  # words in which a pair of this or a lower rank has come up: it goes first
            spots = index.pop(r)
            spots.sort()
            for p in spots:
                if rank[p] != r:
                    continue  # one of its two tokens has been merged meanwhile
                if held and owner[p] in held:
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        heapq.heappush(heap, r)
                    continue
                q = after[p]
                n = after[p] = after[q]
                ids[p], ids[q], rank[q] = r, -1, -1
                if n >= 0:
                    before[n] = p
                    if (x := lookup(key := r << 32 | ids[n])) is None:
                        x = learn(key)
                    rank[p] = x
                    if x >= 0:
                        if x in index:
                            index[x].append(p)
                        else:
                            index[x] = [p]
                            heapq.heappush(heap, x)
                        if x <= r:
                            held.add(owner[p])
                else:
                    rank[p] = -1
                b = before[p]
                if b >= 0:
                    if (x := lookup(key := ids[b] << 32 | r)) is None:
                        x = learn(key)
                    rank[b] = x
                    if x >= 0:
                        if x in index:
                            index[x].append(b)
                        else:
                            index[x] = [b]
                            heapq.heappush(heap, x)
                        if x <= r:
                            held.add(owner[p])
        for k, p, end in spans:
            out[k] = [i for i in ids[p:end] if i >= 0]
        return out


@lru_cache(maxsize=2)
def load_ranks(path: str) -> MergeReplay:
    with open(path, "rb") as f:
        return MergeReplay({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


@lru_cache(maxsize=2)
def encoder_of(ranks_path: str, pattern: str, memo_words: int = MEMO_WORDS) -> Encoder:
    return Encoder(ranks_path, pattern, memo_words)


class Encoder:
    def __init__(self, ranks_path: str, pattern: str, memo_words: int = MEMO_WORDS):
        self.replay, self.find, self.most = load_ranks(ranks_path), regex.compile(pattern).findall, memo_words
        self.replay.most = memo_words * 5 // 4
        self.memo: dict[str, bytes] = {}

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces, memo = [self.find(t) for t in texts], self.memo
        if len(memo) > self.most:  # the words that were met first are the frequent ones
            for p in list(islice(memo, self.most // 2, None)):
                del memo[p]
        fresh = list({p for ps in pieces for p in ps if p not in memo})
        for p, ids in zip(fresh, self.replay.encode([p.encode() for p in fresh]), strict=True):
            memo[p] = np.array(ids, "<u4").tobytes()
        return [b"".join(map(memo.__getitem__, ps)) for ps in pieces]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, memo_words: int = MEMO_WORDS) -> DataFrame:
    """``(id, n_tokens, ids, decoded)`` for each row: ids as little-endian unsigned 32-bit integers, and the bytes that they decode to.

    ``ranks_path`` must be readable on the executors. Whole texts are encoded;
    a null text is an empty one and gives no ids. Repeated rows each keep their
    row; an empty table gives an empty result; other columns may have any names.
    ``memo_words`` bounds what a Python worker remembers.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = encoder_of(ranks_path, pattern, memo_words)  # a worker keeps it for its next task
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < batch.num_rows:
                block, size, start = [], 0, at
                while at < batch.num_rows and (not block or size < BLOCK_CHARS):
                    block.append(texts[at].as_py())
                    size += len(block[-1])
                    at += 1
                ids = encoder.encode_block(block)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, at - start),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([encoder.decode(x) for x in ids] if decode else [None] * len(ids), pa.binary()),
                    ],
                    names=["id", "n_tokens", "ids", "decoded"],
                )

    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded binary")


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op2_bpe_merge_replay(spark, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of what they decode to."""
    out = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabulary())
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
