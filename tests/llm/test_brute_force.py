"""Line rules, Markov spans, the pipeline's first and third stage, and digests over ids of all kinds, each against a plain version."""

import collections
import math
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, TEXTS, base_spans
from tidereel.llm import brown, digests, quality, secrets

SF = "/root/testdata/sf0.001"
ODD = [
    "We use cookies on this page to make it work for you.\n" + "Plain words stand in a line that ends well.\n" * 2 + "Home | News | Sport | More",
    "Home | News | About | More\n" * 5 + "One line of plain words alone, ten of them at least.",
    "a b\nc d\ne f.\n## $$ %% && ||\nThe line of words that follows has no mark at its end but is long",
    "ünï çødé wörds · sind hier · und dort nicht getrennt, denn nur der Zeilenvorschub trennt Zeilen.",
]


@pytest.fixture(scope="module")
def table(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    texts = [*TEXTS, *ODD, TEXTS[0]]
    more = spark.createDataFrame([(10**9 + k, t, "en" if k % 2 else None, None, 1) for k, t in enumerate(texts)] + [(None, "no id and few words", None, None, None)], real.schema)
    return real.unionByName(more).cache()


def plain_words(t):
    return t.encode().split()


def fails(line):
    """The line rules, from their description."""
    n = len(plain_words(line))
    if n == 0:
        return False
    marks, symbols = len(re.findall(r"[|»›•·]", line)), len(re.findall(r"[#*$%&|<>]", line))
    scrap = n < 4 and not re.search("[.!?…:;。！？»”\"')\\]][ \\x09-\\x0D]*\\Z", line)
    return (marks > 0 and 3 * marks >= n) or 2 * symbols >= n or scrap or any(p in line.lower() for p in quality.BOILERPLATE)


def cleaned(t):
    """The text without its failing lines, or None if it is rejected."""
    t = t or ""
    w, lines = plain_words(t), t.split("\n")
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lost = sum(len(plain_words(x)) for x in lines if fails(x))
    if len(w) < 10 or 100 * len(covered) > 20 * len(w) or 2 * lost > len(w):
        return None
    return "\n".join(x for x in lines if not fails(x))


def test_quality_stage_equals_brute_force(spark, table):
    want = collections.Counter((r.doc_id, text, r.lang, r.source, len(text)) for r in table.collect() if (text := cleaned(r.text)) is not None)
    got = collections.Counter(map(tuple, corpus_pipeline.quality_stage(spark, table, SF).collect()))
    assert got == want and 0 < len(want) < table.count()
    assert any(r.text != t for r in table.collect() if r.text and (t := cleaned(r.text)))


def plain_ratio(token, log_ratio):
    """The log-likelihood ratio, one pair of neighbours after another."""
    place = lambda c: secrets.ALPHABET.find(c) + 1
    return sum(log_ratio[place(a), place(b)] for a, b in zip(token, token[1:]))


def plain_model(samples):
    """Both models counted anew: pairs of neighbours with half a count each, by the class of the first."""
    place = lambda c: secrets.ALPHABET.find(c) + 1
    size, counts = len(secrets.ALPHABET) + 1, {True: collections.Counter(), False: collections.Counter()}
    for token, random in samples:
        counts[random].update((place(a), place(b)) for a, b in zip(token, token[1:]))
    total = {r: [sum(counts[r][a, b] + 0.5 for b in range(size)) for a in range(size)] for r in counts}
    return {(a, b): math.log((counts[True][a, b] + 0.5) / total[True][a]) - math.log((counts[False][a, b] + 0.5) / total[False][a]) for a in range(size) for b in range(size)}


def plain_spans(t, log_ratio, mean):
    base = base_spans(t)
    free = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t) if not any(s < m.end() and m.start() < e for s, _, e in base)]
    return base, sorted(base + [(s, k, e) for s, k, e, x in free if plain_ratio(x, log_ratio) >= max(6.0, mean * len(x))])


def masked(t, spans):
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [t[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + t[at:]


def test_markov_spans_and_secrets_stage_equal_brute_force(spark, table):
    samples = secrets.labelled_samples(table, sample_docs=200, strings=200).where("token is not null").cache()
    trained = secrets.train(samples)
    counted = plain_model([(r.token, r.random) for r in samples.collect()])
    size = len(secrets.ALPHABET) + 1
    assert all(trained[a * size + b] == pytest.approx(x, abs=1e-9) for (a, b), x in counted.items())
    texts = {}
    for model in (secrets.Model(trained), secrets.fit(table)):
        known = {(a, b): round(model.table[a * size + b], 6) for a in range(size) for b in range(size)}
        added = 0
        for r in secrets.scan(table, model, doc_id=F.col("doc_id")).collect():
            base, spans = plain_spans(r["__t"], known, model.mean)
            assert ([tuple(s) for s in r.base], [tuple(s) for s in r.spans]) == (base, spans)
            added += len(spans) - len(base)
            texts[r.doc_id, r["__t"]] = masked(r["__t"], spans)
        assert added > 0
    want = collections.Counter((r.doc_id, t, r.lang, r.source, len(t)) for r in table.collect() for t in [texts[r.doc_id, r.text or ""]])
    got = collections.Counter(map(tuple, corpus_pipeline.secrets_stage(spark, table, SF).collect()))
    assert got == want and any("[SECRET]" in t for t in texts.values())


def followed(rows):
    """The texts of each row and the next, by ranges."""
    groups, out = collections.defaultdict(list), []
    for r in rows:
        groups[r.part].append(r)
    for group in groups.values():
        waiting = None
        for r in group:
            if waiting is not None and waiting.b == r.b:
                out.append((waiting.t, r.t))
            waiting = None if r.ghost else r
    return out


def tagged(df):
    return df.withColumn("part", F.spark_partition_id()).collect()


@pytest.mark.parametrize("kind", ["string", "double", "decimal(20,3)", "date", "int"])
def test_successors_of_ids_of_any_type(spark, kind):
    ids = [f"20{k * 37 % 90 + 10}-01-{k % 28 + 1:02}" if kind == "date" else str((k * 7919) % 4001 - 900) for k in range(120)]
    rows = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)] + [(None, "none")], "key string, text string").select(F.col("key").cast(kind).alias("doc_id"), "text", F.lit("x").alias("t"), F.lit(1).alias("k"))
    order = [r.text for r in rows.orderBy("doc_id").collect()]
    assert sorted(followed(tagged(digests.with_next(rows, buckets=7)))) == sorted(zip(order, order[1:] + order[:1], strict=True))
    got = digests.fingerprint_edits(rows)
    assert got.count() == 121 and got.schema["id"].dataType == rows.schema["doc_id"].dataType


def test_rows_of_a_shared_id_spread_over_ranges(spark):
    rows = [(5 if k % 3 else k, f"text {k} " + "x" * 80) for k in range(600)] + [(None, f"none {k}") for k in range(5)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    signed = lambda t: (h := xxhash.xxh64_intdigest(t, 42)) - (h >> 63 << 64)
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))]
    got = tagged(digests.with_next(table, range_bytes=4_000))
    assert sorted(followed(got)) == sorted(zip(order, order[1:] + order[:1], strict=True))
    assert max(collections.Counter(r.b for r in got).values()) < 120  # 400 rows share one id
    assert sorted(followed(tagged(digests.with_next(table)))) == sorted(zip(order, order[1:] + order[:1], strict=True))


def test_whole_result_of_a_shared_id(spark):
    rows = [(1, t, "en", "s", 1, "x", 1, 2, 3, "w", "f", 4, 5, 6) for t in TEXTS[:7]]
    table = spark.createDataFrame(rows, SCHEMA)
    assert digests.fingerprint_edits(table).count() == 7


@pytest.mark.parametrize("sizes", [dict(top=60, clustered=20, classes=5, rounds=2, sweeps=2), dict(top=10**6, clustered=40, classes=3, rounds=1, sweeps=1)])
def test_class_model_scores_equal_brute_force(spark, table, sizes):
    """Tables and scores counted anew from the class that each word was given."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    docs = [(r.doc_id, r.text or "") for r in table.collect()]
    rows = table.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("h"), F.udf(held, "boolean")("doc_id").alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    model, rare, _ = brown.train(rows, **sizes)
    vocab, start, smooth = model.vocab, sizes["classes"], brown.SMOOTH
    rank, far = {bytes(w): k for k, w in enumerate(vocab.words)}, {bytes(r.word): (r.n, r.k) for r in rare.collect()}
    assert not rank.keys() & far.keys() and len(rank) <= sizes["top"]

    def own(w):
        return int(model.own[rank[w]] if w in rank else far[w][1] if w in far else model.own[len(rank) + brown.shape(w)])

    def before(w):
        return int(model.before[rank[w] if rank.get(w, vocab.clustered) < vocab.clustered else vocab.clustered + brown.shape(w)])

    tokens = {(i, t): t.encode().lower().split() for i, t in docs}
    count, follows, total, kinds = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in docs:
        if not held(i):
            w = tokens[i, t]
            count.update(w)
            follows.update(zip([start, *map(before, w)], [*map(own, w), start], strict=True))
    for w, n in count.items():
        total[own(w)] += n
        kinds[own(w)] += 1
    assert all(n == count[w] for w, (n, _) in far.items()) and set(count) == rank.keys() | far.keys()
    sums = [sum(follows[c, o] for o in range(start + 1)) for c in range(start + 1)]
    step = lambda c, o: math.log10((follows[c, o] + smooth) / (sums[c] + smooth * (start + 1)))
    want = collections.defaultdict(list)
    for i, t in docs:
        w = tokens[i, t]
        moves = sum(step(c, o) for c, o in zip([start, *map(before, w)], [*map(own, w), start], strict=True))
        want[i].append(moves + sum(math.log10((count[x] + smooth) / (total[own(x)] + smooth * (kinds[own(x)] + 1))) for x in w))
    got = collections.defaultdict(list)
    for r in brown.score_corpus(table, **sizes).collect():
        got[r.id].append(r.score)
    assert got.keys() == want.keys() and len({own(w) for w in count}) > 1
    for i, scores in want.items():
        assert sorted(got[i]) == pytest.approx(sorted(scores), rel=1e-9)
