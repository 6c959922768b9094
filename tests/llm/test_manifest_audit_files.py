"""The Merkle manifest, the filter audit and the token files against brute force."""

import gc
import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidereel.llm import audit, merkle, rans, tokenfiles

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, pos long, n long, block long, up string, f int, row int, part string, mask int, edge int, chunk string, ids string, id string, t string"
MORE = ("k", 1, 2, 3, "u", 4, 5, "p", 6, 7, "c", "i", "x", "t")
LONG = "A long text that goes on, WITH capitals. " * 9_000


def table(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *MORE) for r in rows], SCHEMA)


def documents():
    con = duckdb.connect()
    return con.execute(f"SELECT doc_id, text, lang, source, n_chars FROM '{FOLDER}/documents.parquet'").fetchall()


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def beside(tree, k):
    out = []
    for nodes in tree[:-1]:
        low = k - k % 3
        out.append((nodes[low:k], nodes[k + 1 : low + 3]))
        k //= 3
    return out


def manifest(rows):
    """``(doc_id, leaf)`` to the answers, for rows (doc_id, text, lang, source, n_chars)."""

    def leaf(r, text):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])

    keys = sorted({r[3] for r in rows}, key=lambda k: (k is not None, (k or "").encode()))
    by = {k: sorted((r for r in rows if r[3] == k), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for k in keys}
    trees = {k: levels([leaf(r, r[1]) for r in by[k]]) for k in keys}
    top, out = levels([trees[k][-1][0] for k in keys]), []
    for j, k in enumerate(keys):
        for i, r in enumerate(by[k]):
            path = beside(trees[k], i) + beside(top, j)
            even = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            x = leaf(r, r[1].replace("\n", "") if even else r[1])
            for left, right in path:
                x = H(*left, x, *right)
            out.append((r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], H(*[d for a, b in path for d in a + b]), x, x == top[-1][0]))
    return out


@pytest.mark.parametrize("height, stacked", [(1, 1), (2, 1), (3, 2), (4, 3), (6, 2)])
def test_traversal_equals_the_whole_tree(height, stacked):
    """Each leaf's path in a block of any size, whether the block is a whole tree or reaches the full height."""
    for n in [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 81, 82, 200, 729]:
        if n > 3**height:
            continue
        leaves = [hashlib.sha256(bytes([k % 256, k // 256])).digest() for k in range(n)]
        for full in (merkle.height_of(n), height):
            tree = levels([x.hex() for x in leaves])
            while len(tree) <= full:
                tree.append([H(tree[-1][0])])
            want = ["".join(d for a, b in beside(tree[: full + 1], k) for d in a + b) for k in range(n)]
            assert [p.hex() for p in merkle.paths(leaves, full, stacked)] == want
            assert merkle.block_root(leaves, full).hex() == tree[full][0]


def test_traversal_holds_few_nodes(monkeypatch):
    """Of a block of 729 leaves the stack holds no more than 12 nodes a subtree, and open runs."""
    held = []

    class Counted(merkle.Subtree):
        def siblings(self, leaf, out):
            held.append(sum(map(len, self.nodes)) + sum(map(len, self.runs)))
            super().siblings(leaf, out)

    monkeypatch.setattr(merkle, "Subtree", Counted)
    for _ in merkle.paths([bytes([k % 256]) * 32 for k in range(729)], 6, 2):
        pass
    assert max(held) <= 9 + 3 + 3 * 6


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_over_several_tiers(spark, height):
    """Blocks of 3 and 9 rows need several tiers of blocks, over rows and over sources; one source has half of all rows."""
    rng = random.Random(height)
    rows = [(k, f"text {k}\nline", "en", "hot" if k % 2 else f"s{rng.randrange(14)}") for k in range(400)]
    docs = table(spark, rows)
    other = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    got = merkle.authenticated(docs, F.col("source"), [F.col("doc_id")], merkle.row_leaf(*other, F.col("text")), height, 2, doc_id=F.col("doc_id"))
    got = {r.doc_id: (r.leaf.hex(), r.subroot.hex(), r.root.hex(), hashlib.sha256(r.siblings.hex().encode()).hexdigest()) for r in merkle.with_folded_root(got, "leaf").where("folded_root = root").collect()}
    assert got == {r[0]: r[1:5] for r in manifest([(*r, len(r[1])) for r in rows])}


def test_manifest_of_odd_rows(spark, tmp_path):
    rows = [(3, "a\nb", "en", None), (None, "none\n", None, None), (7, None, None, "é"), (8, "", "de", "é"), (8, "", "de", "é"), (8, "other", "de", "é"), (9, LONG + "\n", "en", "z"), (-4, "x\n", "en", "")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()
    want = manifest([(*r, None if r[1] is None else len(r[1])) for r in rows])
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r.doc_id for r in got if not r.verified} == {r[0] for r in want if not r[6]}
    table(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert merkle.op11_merkle_manifest(spark, f"{tmp_path}/none").count() == 0


def test_manifest_query(spark):
    got = merkle.op11_merkle_manifest(spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == sorted(manifest(documents()))


# filter audit


def masks(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = t.encode().split()
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in t for c in "#$%&*|"), i is not None and i > least[t]]
        out.append((i, lang or "", sum(1 << k for k, x in enumerate(fails) if x)))
    return out


def odd_documents():
    plain = " ".join(f"word{k}" for k in range(150))
    rows = [(k, plain, "en", "s") for k in range(100, 160)] + [(5, plain, None, "s")] * 40 + [(None, plain, "", "s")] * 3 + [(k, f"UP {k} é" * 30, "de", "s") for k in range(20)]
    return [*rows, (200, None, "en", "s"), (201, "", "en", "s"), (202, LONG, "fr", "s"), (203, LONG, "fr", "s"), (204, "a\x0bb c # d", "fr", "s"), (204, "a\x0bb c # d", "fr", "s"), (3, "low id", "en", "s"), (1, "low id", "en", "s")]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_masks_over_ranges(spark, parts):
    """Copies of a text, and repeated rows of one id, lie in several ranges; a text's first row may lie in the range before."""
    rows = odd_documents()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = audit.failure_masks(table(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert Counter(map(tuple, got)) == Counter(masks(rows))


def test_audit_report(spark, tmp_path):
    rows = odd_documents()
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(1, 1, 0), (3, 1, None), (5, 1, 1), (5, 0, 1), (101, 0, 1), (999, 1, 1), (None, 1, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good, toxic = ({m[0] for m in marks if m[k] == 1 and m[0] is not None} for k in (1, 2))
    want, all_masks = {}, masks(rows)
    for part in {m[1] for m in all_masks}:
        own = [m for m in all_masks if m[1] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [m for m in left if m[2] & bit]
                left = [m for m in left if not m[2] & bit]
                total[letter] += len(gone)
                fails = [m for m in own if m[2] & bit]
                want[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(m[2] == bit for m in own), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone), letter]
        for key in [k for k in want if k[0] == part]:
            want[key][6] = total[want[key][6]]
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in audit.op12_filter_audit(spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 600 * 4
    table(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert audit.op12_filter_audit(spark, f"{tmp_path}/none").count() == 0


# token files


@pytest.mark.parametrize("sizes", [[1], [31, 32, 33], [1, 70_000, 5], [2048 * 32 + 1, 2048 * 32], [600, 30_000]])
def test_chunks_round_trip(sizes):
    rng = np.random.default_rng(len(sizes))
    blocks = [np.minimum(rng.zipf(1.3, n), 50_256).astype(np.uint32) for n in sizes]
    chunk = rans.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, rans.decode(chunk), strict=True))
    assert np.array_equal(rans.decode(chunk, [len(blocks) - 1])[0], blocks[-1])
    for at in (len(chunk) - 3, len(chunk) // 2):
        with pytest.raises(Exception):  # noqa: B017  a checksum or an end that doesn't fit
            rans.decode(chunk[:at] + bytes([chunk[at] ^ 1]) + chunk[at + 1 :])


def test_chunks_are_near_the_entropy():
    rng = np.random.default_rng(5)
    x = np.minimum(rng.zipf(1.2, 1 << 18), 50_256).astype(np.uint32)
    share = np.bincount(x)[np.unique(x)] / len(x)
    bits = -(share * np.log2(share)).sum() * len(x)
    assert bits < len(rans.encode([x[: 1 << 17], x[1 << 17 :]])) * 8 < 1.1 * bits
    assert rans.encode([np.zeros(1 << 16, np.uint32)]).__len__() < 2_000  # one symbol costs nothing but states
    wide = [np.arange(1 << 20, (1 << 20) + 5_000).astype(np.uint32)]
    assert np.array_equal(rans.decode(rans.encode(wide))[0], wide[0])


ODD = [
    "a  b \n c\n\n d e  f  ", "", "  ", "\n", "x\n y", " \t a", "a ", "  b", "é　 x", "it's  5's 'tis\r\n ok", "<|endoftext|> a<|endoftext|>", "\x00\x01 ", "\x1c x\x1d  y\x85 z", "!\x1cb!\x1c\x1f b", "a​ b᠎ c ﻿ d", "a\xa0 b\xa0c!\xa0 ", "one  two", "a\nb\n\nc d\n", LONG,
]


def test_encoder_equals_the_library():
    library, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), tokenfiles.Encoder(tokenfiles.vocabulary(), memo_words=40)
    library.encode_special_tokens = True
    for texts in (ODD, ["one"], [""], [r[1] or "" for r in documents()]):
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in own.encode(pa.array(texts))] == want


def test_encoding_searches_for_no_cycles():
    """New pieces make many lists at once, which Python's collector would walk again and again; pieces of all texts are looked up together."""
    own, calls, found = tokenfiles.Encoder(tokenfiles.vocabulary()), [], []
    ids = own._ids
    own._ids = lambda pieces: calls.append(len(pieces)) or ids(pieces)
    gc.callbacks.append(lambda phase, info: found.append(info["generation"]))
    try:
        got = own.encode(pa.array([f"{k:x}qz k{k * 7919:x}, {k} \n" for k in range(5000)]))
        quiet = not found
    finally:
        gc.callbacks.pop()
    assert quiet and gc.isenabled() and len(got) == 5000 and len(calls) <= 3


def in_files(rows):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    out, start = [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("block, chunk", [(1 << 16, 1 << 22), (50, 400)])
def test_files_of_odd_rows(spark, tmp_path, block, chunk):
    rows = [(k * 3, t) for k, t in enumerate(ODD)] + [(None, "no id"), (1, None)]
    docs = table(spark, [(i, t, "en", "s") for i, t in rows])
    tokenfiles.write_tokens(docs, f"{tmp_path}/t", tokenfiles.vocabulary(), 2, block_tokens=block, chunk_tokens=chunk)
    got = tokenfiles.read_tokens(spark, f"{tmp_path}/t").select("id", "start", "n_tokens", F.crc32("ids").alias("c")).orderBy("start").collect()
    assert list(map(tuple, got)) == in_files(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    tokenfiles.write_tokens(table(spark, []), f"{tmp_path}/none", tokenfiles.vocabulary(), 2)
    assert tokenfiles.read_tokens(spark, f"{tmp_path}/none").count() == 0


def test_rows_of_one_id_spread_over_files(spark, tmp_path):
    rows = [(1, f"text {k % 50} of many", "en", "s") for k in range(400)]
    tokenfiles.write_tokens(table(spark, rows), f"{tmp_path}/t", tokenfiles.vocabulary(), 2)
    assert spark.read.parquet(f"{tmp_path}/t/chunks").select("part").distinct().count() > 1
    got = tokenfiles.read_tokens(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert len(got) == 400 and [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_files_query(spark):
    got = tokenfiles.op13_rans_files(spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == in_files(sorted((r[0], r[1]) for r in documents()))
