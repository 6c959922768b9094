"""A static range asymmetric numeral system over token ids, as array code over many lanes at once.

A chunk of token sequences (blocks) shares one frequency table. A block is cut
into lanes: token ``t`` belongs to lane ``t % lanes``, and each lane has a
state of its own, so a step over all lanes of all blocks is a few array
operations. Blocks don't depend on each other. Every ``CHECK`` steps the states
of the lanes are kept as a checkpoint, with the place in the block's words, so
a block is read from all of its checkpoints at once. Each block has checksums
of its bytes and of its ids, and each stretch must end in the states with
which the next one begins.

Layout, little-endian: ``HEAD`` (magic, version, bytes of the table, blocks);
the table, deflated: differences of the symbols, then their frequencies, as
32-bit numbers; for each block ``BLOCK`` (tokens, lanes, checkpoints, words,
checksum of the body, checksum of the ids as 32-bit integers); then the bodies:
64-bit states of each checkpoint, 32-bit word offsets of the checkpoints, words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Frequencies of a table add up to ``1 << SCALE``; states are from ``LOW`` up to ``LOW << 32``.
SCALE, LOW = 20, 1 << 31
#: Least lanes of a block, steps that a block has at most, steps between checkpoints.
LANES, STEPS, CHECK = 32, 2_048, 512
HEAD, BLOCK = struct.Struct("<4sHxxII"), struct.Struct("<IIIIII")
MAGIC, VERSION = b"RTOK", 1
_SCALE, _MASK, _LOW, _32, _WORD = np.uint64(SCALE), np.uint64((1 << SCALE) - 1), np.uint64(LOW), np.uint64(32), np.uint64(0xFFFFFFFF)


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to ``1 << SCALE``, at least 1 each; the remainder goes to the largest fractions, the first of equals."""
    counts, room = counts.astype(np.int64), (1 << SCALE) - len(counts)
    if room < 0:
        raise ValueError("more symbols than a table can hold")
    share, rest = np.divmod(counts * room, max(int(counts.sum()), 1))
    freq = share + 1
    freq[np.argsort(-rest, kind="stable")[: (1 << SCALE) - int(freq.sum())]] += 1
    return freq


def lanes_of(tokens: int) -> int:
    """A power of two, so that a block has ``STEPS`` steps at most however long it is."""
    return max(LANES, 1 << max(0, -(-tokens // STEPS) - 1).bit_length())


def _ranked(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, the rank of each token's id, and how often each is there."""
    if flat.max() >= 1 << 20:
        return np.unique(flat.astype(np.int64), return_inverse=True, return_counts=True)
    counts = np.bincount(flat)
    symbols = np.flatnonzero(counts)
    rank = np.zeros(len(counts), np.int32)
    rank[symbols] = np.arange(len(symbols), dtype=np.int32)
    return symbols, rank[flat], counts[symbols]


def encode(blocks: list[np.ndarray]) -> bytes:
    """One chunk of ``blocks`` of ids (each at least one token, ids below 2 ** 32)."""
    symbols, at, counts = _ranked(np.concatenate(blocks))
    freq = quantised(counts)
    # the last entry is for places beyond a block's end: it leaves a state as it is
    f = np.append(freq, 1 << SCALE).astype(np.uint64)
    c = np.append(np.cumsum(freq) - freq, 0).astype(np.uint64)
    lanes = [lanes_of(len(b)) for b in blocks]
    steps = [-(-len(b) // n) for b, n in zip(blocks, lanes, strict=True)]
    left = np.cumsum([0, *lanes])
    tall, wide = max(steps), int(left[-1])
    grid, start = np.full((tall, wide), len(symbols), np.int32), 0
    for k, b in enumerate(blocks):
        own = np.full(steps[k] * lanes[k], len(symbols), np.int32)
        own[: len(b)] = at[start : start + len(b)]
        grid[: steps[k], left[k] : left[k + 1]] = own.reshape(steps[k], lanes[k])
        start += len(b)
    words, sent = np.empty((tall, wide), np.uint32), np.empty((tall, wide), bool)
    x, kept = np.full(wide, LOW, np.uint64), {}
    limit = f << np.uint64(63 - SCALE)
    for s in range(tall - 1, -1, -1):
        g = grid[s]
        own = f[g]
        over = np.greater_equal(x, limit[g], out=sent[s])
        words[s] = x & _WORD
        x = np.where(over, x >> _32, x)
        q = x // own
        x = (q << _SCALE) + (x - q * own) + c[g]
        if s % CHECK == 0:
            kept[s] = x
    heads, bodies, start = [], [], 0
    for k, b in enumerate(blocks):
        own = slice(left[k], left[k + 1])
        out = sent[: steps[k], own]
        marks = range(0, steps[k], CHECK)
        before = np.cumsum([0, *out.sum(axis=1)])[list(marks)].astype("<u4")
        stream = words[: steps[k], own][out].astype("<u4")
        body = b"".join([*(kept[s][own].astype("<u8").tobytes() for s in marks), before.tobytes(), stream.tobytes()])
        heads.append(BLOCK.pack(len(b), lanes[k], len(marks), len(stream), zlib.crc32(body), zlib.crc32(b.astype("<u4").tobytes())))
        bodies.append(body)
        start += len(b)
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    return b"".join([HEAD.pack(MAGIC, VERSION, len(table), len(blocks)), table, *heads, *bodies])


def decode(chunk: bytes, wanted: list[int] | None = None) -> list[np.ndarray]:
    """The ids of all blocks of a chunk, or of the ``wanted`` ones; a wrong checksum is an error."""
    magic, version, size, n = HEAD.unpack_from(chunk)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a chunk of this format")
    table = np.frombuffer(zlib.decompress(chunk[HEAD.size : HEAD.size + size]), "<u4").astype(np.int64)
    symbols, freq = np.cumsum(table[: len(table) // 2]), table[len(table) // 2 :]
    f, c = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    owner = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    heads = [BLOCK.unpack_from(chunk, HEAD.size + size + k * BLOCK.size) for k in range(n)]
    at = HEAD.size + size + n * BLOCK.size
    states, ends, places, words, parts, base = [], [], [], [], [], 0  # a part is what stands between two checkpoints
    wanted = list(range(n)) if wanted is None else wanted
    for k, (tokens, lanes, marks, n_words, body_crc, _) in enumerate(heads):
        length = marks * lanes * 8 + marks * 4 + n_words * 4
        body = chunk[at : at + length]
        at += length
        if k not in wanted:
            continue
        if len(body) != length or zlib.crc32(body) != body_crc:
            raise ValueError(f"block {k} is damaged")
        own = np.frombuffer(body, "<u8", marks * lanes).reshape(marks, lanes)
        before = np.frombuffer(body, "<u4", marks, marks * lanes * 8).astype(np.int64)
        steps = -(-tokens // lanes)
        for m in range(marks):
            states.append(own[m])
            ends.append(own[m + 1] if m + 1 < marks else np.full(lanes, LOW, np.uint64))
            places.append(base + before[m])
            full, first = min(CHECK, steps - m * CHECK), m * CHECK * lanes
            parts.append((k, lanes, full, np.clip(-(-(tokens - first - np.arange(lanes)) // lanes), 0, full)))
        words.append(np.frombuffer(body, "<u4", n_words, marks * lanes * 8 + marks * 4))
        base += n_words
    if not parts:
        return []
    x, place = np.concatenate(states).astype(np.uint64), np.array(places, np.int64)
    stream = np.concatenate(words).astype(np.uint64)
    part_of = np.repeat(np.arange(len(parts)), [p[1] for p in parts])
    count = np.concatenate([p[3] for p in parts])
    tall, whole = int(count.max()), int(count.min())
    out = np.empty((tall, len(x)), np.int32)
    for s in range(tall):
        slot = x & _MASK
        g = owner[slot]
        out[s] = g
        y = f[g] * (x >> _SCALE) + slot - c[g]
        if s >= whole:
            y = np.where(s < count, y, x)
        low = np.flatnonzero(y < _LOW)
        if len(low):
            of = part_of[low]
            took = np.bincount(of, minlength=len(place))
            rank = np.arange(len(low)) - (np.cumsum(took) - took)[of]
            y[low] = y[low] << _32 | stream[place[of] + rank]
            place += took
        x = y
    if not np.array_equal(x, np.concatenate(ends)):
        raise ValueError("a stretch doesn't end where the next begins")
    left, got = 0, {}
    for k, lanes, full, _ in parts:
        got.setdefault(k, []).append(out[:full, left : left + lanes].ravel())
        left += lanes
    ids = []
    for k in wanted:
        tokens, *_, crc = heads[k]
        b = symbols[np.concatenate(got[k])[:tokens]].astype("<u4")
        if zlib.crc32(b.tobytes()) != crc:
            raise ValueError(f"the ids of block {k} are damaged")
        ids.append(b)
    return ids
