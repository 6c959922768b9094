"""Language-model scores from a Brown class-based bigram model.

1. Frequent words, and shapes that stand for all other words, are symbols.
   Exchange over their bigrams gives each a class: that of a word as the one
   *before*. A round's sums are a Spark job.
2. Every word of the training texts, however rare, gets a class of its own as
   the one that *follows*: in sweeps over the whole vocabulary, which is a
   table in Spark, each word moves to the class under which the classes before
   it are most likely.
3. A text is scored by transitions from the class before to the word's class,
   times word emissions of that class, both smoothed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, stored, text_bytes

#: Words that are sent to every task with their counts (at most some 5 MB, and 50 MB in a Python worker);
#: the first of them, by frequency, are clustered one by one.
TOP_WORDS, CLUSTERED, CLASSES, ROUNDS = 262_144, 2_000, 32, 5
#: Most sweeps of the exchange over all words.
SWEEPS = 6
SHAPES, SMOOTH = 24, 0.1
#: What a task works on at once: bytes of text that are cut into words, tokens that are counted, distinct words that are kept until they are handed on.
CUT_BYTES, HELD_TOKENS, HELD_WORDS = 2 << 20, 2_000_000, 400_000
END = b""


def shape(w: bytes) -> int:
    """One of ``SHAPES`` kinds of word: final mark, beyond ASCII, digits, length."""
    bare = w.rstrip(b".,;:!?\"')")
    digit = any(48 <= c < 58 for c in bare)
    return ((len(bare) > 4) + (len(bare) > 8)) * 8 + (bare != w) * 4 + (not w.isascii()) * 2 + digit


class _Ids(dict):
    """Word to its rank; beyond the frequent words, the shape."""

    base = 0

    def __missing__(self, w: bytes) -> int:
        return self.base + shape(w)


@dataclass
class Vocabulary:
    """The frequent words by descending count; never more than ``TOP_WORDS``."""

    words: list[bytes]
    counts: np.ndarray
    clustered: int
    end_count: int

    @property
    def symbols(self) -> int:
        return self.clustered + SHAPES

    def ids(self) -> _Ids:
        d = _Ids(zip(self.words, range(len(self.words)), strict=True))
        d.base = len(self.words)
        return d

    def symbol_of(self) -> np.ndarray:
        tail = [self.clustered + shape(w) for w in self.words[self.clustered :]]
        return np.array([*range(self.clustered), *tail, *range(self.clustered, self.clustered + SHAPES)], np.int64)


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z lower-cased, and how many there are up to the end of each text."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    ends, words = cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py(), cut.flatten()
    whole = pc.greater(pc.binary_length(words), 0)  # blanks at an end leave an empty word
    kept = np.r_[0, np.cumsum(whole.to_numpy(zero_copy_only=False))]
    return words.filter(whole).view(pa.binary()), kept[ends]


def _slices(batches, at: int):
    """Slices whose texts, in column ``at``, have about ``CUT_BYTES``: a whole batch cut into words takes many times its size. A text is never cut."""
    for b in batches:
        part = np.cumsum(pc.binary_length(b.column(at)).to_numpy(zero_copy_only=False).astype(np.int64)) // CUT_BYTES
        cut = [*np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)]).tolist(), len(part)]
        for x, y in zip(cut, cut[1:], strict=False):
            yield b.slice(x, y - x)
    pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds nothing


def _added(held: list[pa.Table]) -> pa.Table:
    """The tables ``(word, n)`` as one, with a row for each word."""
    return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])


def word_counts(rows: DataFrame) -> DataFrame:
    """``(word, n)`` over ``rows(id, t)``; the end of a text is the empty word. A task's words add up before the shuffle, ``HELD_WORDS`` at a time."""

    def count(batches):
        held, size, due, ends = [], 0, HELD_WORDS, 0
        for b in _slices(batches, 1):
            found = _cut(b.column(1))[0].value_counts()
            held.append(pa.table([found.field(0), found.field(1)], names=["word", "n"]))
            size, ends = size + len(found), ends + b.num_rows
            if size > due:
                held = [_added(held)]
                if held[0].num_rows > HELD_WORDS:
                    yield from held[0].to_batches(max_chunksize=100_000)
                    held = []
                size = sum(t.num_rows for t in held)
                due = size + HELD_WORDS
        held.append(pa.table([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "n"]))
        if ends:
            yield from _added(held).to_batches(max_chunksize=100_000)

    return rows.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def tokenise(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``rows(id, h, held_out, t)`` to ``(id, h, held_out, w, far)``.

    ``w`` holds 32-bit numbers: the rank of a frequent word, then one for each
    shape, last the end of a text. ``far`` are the other words, joined by blanks.
    """
    shared, kind = rows.sparkSession.sparkContext.broadcast(vocab), rows.schema["id"].dataType.simpleString()

    def run(batches):
        v = shared.value
        get, top = v.ids().__getitem__, len(v.words)
        for batch in _slices(batches, 3):
            words, ends = _cut(batch.column(3))
            told = words.dictionary_encode()
            names = told.dictionary.to_numpy(zero_copy_only=False).tolist()
            ids = np.fromiter(map(get, names), np.int32, len(names))[told.indices.to_numpy(zero_copy_only=False)]
            rare = ids >= top
            place = np.r_[0, np.cumsum(rare)][np.r_[0, ends]].astype(np.int32)
            far = pc.binary_join(pa.ListArray.from_arrays(pa.array(place), words.filter(pa.array(rare))), b" ")
            w = np.insert(ids, ends, top + SHAPES).astype("<i4")
            places = np.r_[0, ends + np.arange(1, len(ends) + 1)] * 4
            numbers = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(w.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], numbers, far], names=["id", "h", "held_out", "w", "far"])

    return rows.mapInArrow(run, f"id {kind}, h long, held_out boolean, w binary, far binary")


def _pieces(batches, at: int):
    """Slices of about a million tokens: ``(slice, w, lengths, first)``, ``first`` being where each text starts."""
    for b in batches:
        size = pc.binary_length(b.column(at)).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        part = np.cumsum(size) // (1 << 20)
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(size) else np.zeros(0, np.int64)
        for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(size)], strict=False):
            piece, n = b.slice(x, y - x), size[x:y]
            yield piece, np.frombuffer(b"".join(piece.column(at).to_pylist()), np.int32), n, np.cumsum(n) - n


def _previous(of: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """What stands before each token; ``start`` at the start of a text."""
    out = np.empty_like(of)
    out[1:] = of[:-1]
    out[first] = start
    return out


def symbol_bigrams(tokens: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``(a, b, n)``; symbols beyond the last are the start and the end of a text."""
    shared, width = tokens.sparkSession.sparkContext.broadcast(vocab), vocab.symbols + 2

    def count(batches):
        v = shared.value
        symbol, held, size = np.append(v.symbol_of(), v.symbols + 1), [], 0

        def give():
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((code // width).astype(np.int32)), pa.array((code % width).astype(np.int32)), pa.array(n.astype(np.int64))], names=["a", "b", "n"])

        for _, w, _, first in _pieces(batches, 0):
            s = symbol[w]
            held.append(_previous(s, first, v.symbols) * width + s)
            size += len(s)
            if size > HELD_TOKENS:
                yield give()
                held, size = [], 0
        if held:
            yield give()

    return tokens.select("w").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _move(w: int, classes: np.ndarray, table: np.ndarray, right: np.ndarray, left: np.ndarray, own: float, free: int) -> None:
    """Takes symbol ``w`` out of its class and puts it where the likelihood of the class bigrams is highest; ties go to the lower class."""
    c = classes[w]
    r, lf = right.copy(), left.copy()
    r[c], lf[c] = max(0, r[c] - own), max(0, lf[c] - own)  # its own company moves with it
    table[c] -= r
    table[:, c] -= lf
    table[c, c] -= own
    np.maximum(table, 0, out=table)
    out, into = table.sum(axis=1), table.sum(axis=0)
    old, rows, cols, corner = _xlogx(table), table[:free] + r, table[:, :free].T + lf, table.diagonal()[:free]
    gain = (_xlogx(rows) - old[:free]).sum(axis=1) + (_xlogx(cols) - old[:, :free].T).sum(axis=1)
    gain += _xlogx(corner + r[:free] + lf[:free] + own) + _xlogx(corner) - _xlogx(corner + r[:free]) - _xlogx(corner + lf[:free])
    gain -= _xlogx(out[:free] + r.sum() + own) + _xlogx(into[:free] + lf.sum() + own) - _xlogx(out[:free]) - _xlogx(into[:free])
    where = int(np.argmax(gain >= gain.max() - 1e-9))
    classes[w] = where
    table[where] += r
    table[:, where] += lf
    table[where, where] += own


def exchange(bigrams: DataFrame, symbols: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each symbol (start and end keep classes of their own), and the class bigram counts.

    A round's context counts are one job; at most ``symbols x (classes + 2)``
    numbers a side reach the driver.
    """
    spark, total = bigrams.sparkSession, classes + 2
    of = np.concatenate([np.arange(symbols) % classes, [classes, classes + 1]])
    table = np.zeros((total, total))
    for step in range(rounds + 1):
        names = F.split(F.lit(",".join(map(str, of.tolist()))), ",").cast("array<int>")
        both = bigrams.select("a", "b", "n", F.get(names, F.col("a")).alias("ca"), F.get(names, F.col("b")).alias("cb"))
        table[:] = 0
        for x in both.groupBy("ca", "cb").agg(F.sum("n").alias("n")).collect():
            table[x.ca, x.cb] = x.n
        if step == rounds:
            break
        sides = both.select(F.explode(F.array(F.struct(F.col("a").alias("w"), F.lit(0).alias("side"), F.col("cb").alias("c"), "n"), F.struct(F.col("b").alias("w"), F.lit(1).alias("side"), F.col("ca").alias("c"), "n"), F.struct(F.col("a").alias("w"), F.lit(2).alias("side"), F.lit(0).alias("c"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("n")))).alias("x"))
        context = np.zeros((3, symbols + 2, total))
        for x in sides.groupBy("x.w", "x.side", "x.c").agg(F.sum("x.n").alias("n")).collect():
            context[x.side, x.w, x.c] = x.n
        moves = [w for w in range(symbols) if context[:2, w].any() and (step == 0 or w % 2 == step % 2)]  # half a round at a time, or neighbours swap back and forth
        for w in moves:
            _move(w, of, table, context[0, w], context[1, w], context[2, w, 0], classes)
    return of, table


@dataclass
class Brown:
    vocab: Vocabulary
    before: np.ndarray  # class of a symbol as the word before
    own: np.ndarray  # class of each frequent word, then of each shape, for words that training lacks
    transition: np.ndarray  # log10
    class_total: np.ndarray
    class_size: np.ndarray
    tokens: int
    distinct: int

    def floor(self, c) -> np.ndarray:
        """log10 of what divides an emission count of a class."""
        return np.log10(self.class_total[c] + SMOOTH * (self.class_size[c] + 1))


def _contexts(tokens: DataFrame, vocab: Vocabulary, of: np.ndarray, classes: int) -> DataFrame:
    """``(w, word, near)`` for each training word: how often it follows which class. ``word`` is null for frequent ones."""
    shared, width, names = tokens.sparkSession.sparkContext.broadcast(vocab), classes + 1, ["w", "word", "c", "n"]

    def count(batches):
        v = shared.value
        top, held, words, after, size = len(v.words), [], [], [], 0
        before = of[np.append(v.symbol_of(), v.symbols + 1)]

        def give():
            code, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((code // width).astype(np.int32)), pa.nulls(len(code), pa.binary()), pa.array((code % width).astype(np.int32)), pa.array(n.astype(np.int64))], names=names)
            far = pa.table({"word": pa.array(words, pa.binary()), "c": pa.array(np.concatenate(after).astype(np.int32))})
            for b in far.group_by(["word", "c"], use_threads=False).aggregate([([], "count_all")]).to_batches(max_chunksize=100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, top, np.int32)), b.column("word"), b.column("c"), b.column("count_all")], names=names)

        for piece, w, _, first in _pieces(batches, 0):
            c = _previous(before[w], first, classes)
            near, rare = w < top, (w >= top) & (w < top + SHAPES)
            held.append(w[near].astype(np.int64) * width + c[near])
            words += b" ".join(piece.column(1).to_pylist()).split()
            after.append(c[rare])
            size += len(w)
            if size > HELD_TOKENS:
                yield from give()
                held, words, after, size = [], [], [], 0
        if held:
            yield from give()

    seen = tokens.select("w", "far").mapInArrow(count, "w int, word binary, c int, n long")
    sums = seen.groupBy("w", "word", "c").agg(F.sum("n").alias("n"))
    return stored(sums.groupBy("w", "word").agg(F.sort_array(F.collect_list(F.struct("c", "n"))).alias("near")))


def _profile(near: pa.Array, classes: int) -> np.ndarray:
    """One row for each word: its count after each class, the start being the last one."""
    size, flat = np.diff(near.offsets.to_numpy()), near.flatten()
    out = np.zeros((len(near), classes + 1))
    out[np.repeat(np.arange(len(near)), size), flat.field(0).to_numpy()] = flat.field(1).to_numpy()
    return out


def _fit(table: np.ndarray) -> np.ndarray:
    """log of the share that each class before has in a class: what a word's counts are weighed with."""
    return np.log((table + SMOOTH) / (table.sum(axis=0) + SMOOTH * len(table)))


def assign(contexts: DataFrame, table: np.ndarray) -> DataFrame:
    """``(w, word, n, k)``: each word in the class under which its company is most likely; ties go to the lower class."""
    fit = _fit(table)

    def run(batches):
        for b in batches:
            near = _profile(b.column(2), fit.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.sum(axis=1).astype(np.int64)), pa.array((near @ fit).argmax(axis=1).astype(np.int32))], names=["w", "word", "n", "k"])

    return contexts.mapInArrow(run, "w int, word binary, n long, k int")


def spread(contexts: DataFrame, table: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exchange over the whole vocabulary: all words move at once to their best class, then the class table is summed anew.

    ``table`` has a row for each class before (the start last) and a column for
    each class. With the shares of the last table given, a sweep can't lower the
    likelihood; it ends when the gain is under a thousandth. Gives the table
    that the last sweep assigned with, the one that came of it, and the number
    of words of each class. Words that are alike in all counts move together,
    as one row. A task sends one table to the sum.
    """
    rows, classes = table.shape
    last = -np.inf
    alike = stored(contexts.groupBy("near").agg(F.count("*").alias("words")))
    for _ in range(sweeps):
        fit = _fit(table)

        def run(batches, fit=fit):
            total = np.zeros((rows + 1, classes))
            for b in batches:
                near, words = _profile(b.column(0), classes), b.column(1).to_numpy()
                best = (near @ fit).argmax(axis=1)
                total[:-1] += (near * words[:, None]).T @ np.eye(classes)[best]
                total[-1] += np.bincount(best, words, classes)
            c, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[c, k].astype(np.int64))], names=["c", "k", "n"])

        new = np.zeros((rows + 1, classes))
        for x in alike.mapInArrow(run, "c int, k int, n long").groupBy("c", "k").agg(F.sum("n").alias("n")).collect():
            new[x.c, x.k] = x.n
        used, table, size = table, new[:-1], new[-1]
        gain = _xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum()
        if gain - last < abs(gain) / 1000:
            break
        last = gain
    return used, table, size


def _frequent(counts: DataFrame, top: int) -> list[tuple[bytes, int]]:
    """At most ``top`` words by descending count, those of one count all or none.

    The count from which words are frequent is found from how many words have
    each count, so no task sends ``top`` words of its own to the driver.
    """
    tally, taken, least = counts.groupBy("n").agg(F.count("*").alias("words")).collect(), 0, 1 << 62
    for x in sorted(tally, reverse=True):
        if (taken := taken + x.words) > top:
            break
        least = x.n
    found = counts.where(F.col("n") >= least).select("word", "n").toArrow()
    return sorted(zip(*(c.to_pylist() for c in found.columns), strict=True), key=lambda x: (-x[1], x[0]))


def train(rows: DataFrame, top: int = TOP_WORDS, clustered: int = CLUSTERED, classes: int = CLASSES, rounds: int = ROUNDS, sweeps: int = SWEEPS) -> tuple[Brown, DataFrame, DataFrame]:
    """Learns from those of ``rows(id, h, held_out, t)`` that aren't held out.

    Gives the model, ``(word, n, k)`` with count and class of the words that
    aren't frequent, and the tokens of all rows; the last two stay in Spark.
    """
    counts = stored(word_counts(rows.where(~F.col("held_out")).select("id", "t")))
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))).alias("e")).first()
    first = _frequent(counts.where(F.col("word") != F.lit(END)), top)
    vocab = Vocabulary([w for w, _ in first], np.array([n for _, n in first], np.int64), min(clustered, len(first)), whole.e or 0)
    tokens = stored(tokenise(rows, vocab))
    learned = tokens.where(~F.col("held_out"))
    of, table = exchange(durable(symbol_bigrams(learned, vocab)), vocab.symbols, classes, rounds)
    contexts = _contexts(learned, vocab, of, classes)
    used, inner, size = spread(contexts, table[: classes + 1, :classes], sweeps)
    own = np.concatenate([np.zeros(len(first), np.int64), of[vocab.clustered : vocab.symbols]])
    near = assign(contexts.where(F.col("word").isNull()), used).select("w", "k").toArrow()  # at most ``top`` rows
    own[near["w"].to_numpy()] = near["k"].to_numpy()
    full = np.column_stack([inner, table[: classes + 1, classes + 1]])  # the end is the last column; nothing leads to the start
    smooth = np.log10((full + SMOOTH) / (full.sum(axis=1, keepdims=True) + SMOOTH * (classes + 1)))
    model = Brown(vocab, of, own, smooth, inner.sum(axis=0), size, whole.n or 0, whole.v)
    return model, assign(contexts.where(F.col("word").isNotNull()), used).select("word", "n", "k"), tokens


def score(rows: DataFrame, model: Brown, rare: DataFrame) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, base_score, score)`` for rows of ``tokenise``.

    Frequent words are scored where they stand; each
    other word goes to its count and class, with the class before it. A
    document's own row takes the same way under a key that no word has.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()
    base_floor = float(np.log10(model.tokens + SMOOTH * (model.distinct + 1)))
    names = ["id", "h", "held_out", "word", "c", "o", "n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        m = shared.value
        v, top, classes = m.vocab, len(m.vocab.words), len(m.class_total)
        before, own = m.before[np.append(v.symbol_of(), v.symbols + 1)], np.append(m.own, classes)
        shapes = np.zeros(SHAPES)
        base = np.concatenate([np.log10(v.counts + SMOOTH) - base_floor, shapes, [np.log10(v.end_count + SMOOTH) - base_floor]])
        emit = np.concatenate([np.log10(v.counts + SMOOTH) - m.floor(m.own[:top]), shapes, [0.0]])
        known = np.concatenate([np.ones(top), shapes, [float(v.end_count > 0)]])
        for piece, w, n, first in _pieces(batches, 3):
            c, o, rare = _previous(before[w], first, classes), own[w], (w >= top) & (w < top + SHAPES)
            doc = np.repeat(np.arange(len(n)), n)
            each = [np.bincount(doc, x, len(n)) for x in (known[w], base[w], np.where(rare, 0.0, m.transition[c, o]) + emit[w])]
            keys = pa.array([b" %d %d" % x for x in enumerate(piece.column(1).to_pylist())], pa.binary())
            none, heads = pa.nulls(len(n), pa.int32()), piece.columns[:3]
            yield pa.RecordBatch.from_arrays([*heads, keys, none, none, pa.array(n.astype(np.int32)), pa.array(each[0].astype(np.int32)), pa.array(each[1]), pa.array(each[2])], names=names)
            far, at, c, o = b" ".join(piece.column(4).to_pylist()).split(), doc[rare], c[rare].astype(np.int32), o[rare].astype(np.int32)
            for x in range(0, len(far), 50_000):
                p = slice(x, x + 50_000)
                i, d = (pa.nulls(len(at[p]), t) for t in (pa.int32(), pa.float64()))
                yield pa.RecordBatch.from_arrays([*(y.take(pa.array(at[p])) for y in heads), pa.array(far[p], pa.binary()), pa.array(c[p]), pa.array(o[p]), i, i, d, d], names=names)

    def listed(x: np.ndarray):
        return F.split(F.lit(",".join(f"{y:.17g}" for y in x.ravel())), ",").cast("array<double>")

    sent = rows.mapInArrow(run, f"id {kind}, h long, held_out boolean, word binary, c int, o int, n_tokens int, n_known int, base_score double, score double")
    far, own = F.col("n_tokens").isNull(), F.coalesce("k", "o")
    log = F.log10(F.coalesce(F.col("n"), F.lit(0)) + SMOOTH)
    step = F.get(listed(model.transition), F.col("c") * model.transition.shape[1] + own)
    emission = log - F.get(listed(model.floor(np.arange(len(model.class_total)))), own)
    sums = sent.join(rare, "word", "left").groupBy("id", "h").agg(
        F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.when(far, F.col("n").isNotNull().cast("int")).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(far, log - base_floor).otherwise(F.col("base_score"))).alias("base_score"), F.sum(F.when(far, step + emission).otherwise(F.col("score"))).alias("score"), F.count("n_tokens").alias("m"),
    )
    # rows that repeat id and text are summed up together, and each gets its share
    one = [F.expr(f"{x} div m").alias(x) for x in ("n_tokens", "n_known")] + [(F.col(x) / F.col("m")).alias(x) for x in ("base_score", "score")]
    return sums.select("id", "held_out", *one, F.explode(F.sequence(F.lit(1), "m")).alias("copy")).drop("copy")


def score_corpus(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``.

    Learns from the rows whose CRC32 of the id as text leaves a rest by
    ``folds``; a null id counts as an empty text, and so is held out. A null
    text is an empty one: one token, its end. With no training row every
    base score is 0. Repeated rows each keep their row; an empty table gives
    an empty result; other columns may have any names; long texts are read
    whole.
    """
    text = text_bytes(text_col)
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), held.alias("held_out"), text.alias("t"))
    model, rare, tokens = train(rows, **sizes)
    return score(tokens, model, rare).select("id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_brown_classes(spark, sf_dir: str) -> DataFrame:
    """Scores of each document."""
    out = score_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
