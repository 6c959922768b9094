"""Secret scans: patterns, and character Markov models for what they miss.

Two first-order models over character classes, one of random strings and one
of ordinary identifiers, are trained from labelled samples. A long token is a
secret if the log-likelihood ratio of the two is high; how high is chosen on a
part of the samples that training hasn't seen. All is column expressions; the
trained table (65 x 65 numbers) becomes a literal.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, fixed by the contract. Minimal lengths of the last two are part of the pattern: a run is taken whole.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, ASSIGN_LENGTH = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", 6
KINDS = ("assign", "access", "hex", "markov")
#: What the models judge.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"
#: Bounds on the labelled samples: documents whose words are ordinary, and strings of each made-up kind.
SAMPLE_DOCS, SAMPLE_STRINGS = 2_000, 4_000
#: Words of programs, for ordinary identifiers beside those of the corpus.
WORDS = (
    "get set user name index file path value count list item node tree data type size time date start stop first last next find load save read write open close update create delete "
    "remove insert select filter group order limit offset result error message request response server client config default option handle event state cache table column row key field "
    "page view model service manager factory builder helper util test main run build version release report summary total average number string buffer stream input output parse format"
).split()
#: One sample in so many is kept from training, to choose the threshold: so far on the way from what this share of the long ordinary ones lies above to what this share of the random ones lies below.
HELD_OUT, ALARMS, MISSES, BETWEEN = 5, 0.002, 0.01, 0.6
#: Nats of evidence over the whole token, and least for each character, from which it is a secret.
LEAST_TOTAL, LEAST_MEAN = 6.0, 0.15
#: Matches that are placed one after another before their places are added up.
CHUNK = 64

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def find_spans(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end) in code points; ``least``: length of group 2."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else found
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    rows = F.arrays_zip(gaps.alias("g"), F.transform(found, F.char_length).alias("m"), F.transform(value, F.char_length).alias("v"))

    def step(acc, x):
        start = acc["at"] + x["g"]
        end = start + F.coalesce(x["m"], F.lit(0))
        hit = x["m"].isNotNull() & (x["v"] >= least)
        spans = F.when(hit, F.array_append(acc["spans"], F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))).otherwise(acc["spans"])
        return F.struct(end.cast("int").alias("at"), spans.cast(_SPAN).alias("spans"))

    # places within chunks of matches, then the chunks' own places: an append copies a chunk, not all that came before
    empty, zero = F.array().cast(_SPAN), F.lit(0)
    chunks = F.transform(F.sequence(zero, F.floor((F.size(rows) - 1) / CHUNK).cast("int")), lambda k: F.aggregate(F.slice(rows, k * CHUNK + 1, F.lit(CHUNK)), F.struct(zero.alias("at"), empty.alias("spans")), step))

    def shift(acc, x):
        moved = F.transform(x["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["spans"], moved).alias("spans"))

    placed = F.aggregate(chunks, F.struct(zero.alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans")), shift, lambda acc: F.flatten(acc["spans"]))
    return F.when(text.rlike(pattern), placed).otherwise(empty)


@dataclass(frozen=True)
class Model:
    """The log-likelihood ratio of each pair of classes, in row order, and the nats a character from which a token is a secret."""

    table: tuple[float, ...]
    mean: float = LEAST_MEAN


def _codes(token: Column) -> Column:
    """Class of each character: its place in the alphabet, 0 for any other."""
    return F.transform(F.split(token, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(ALPHABET), c)))


def train(samples: DataFrame) -> tuple[float, ...]:
    """``samples(token, random)`` to the log-likelihood ratio of each pair of classes, in row order.

    Both models are smoothed by half a count for each class. The counts, at
    most two for each pair, are all that reaches the driver.
    """
    size = len(ALPHABET) + 1
    codes = samples.where("token is not null").select(F.col("random").alias("r"), _codes(F.col("token")).alias("c"))
    pairs = codes.where(F.size("c") > 1).select("r", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.get("c", i) * size + F.get("c", i + 1))).alias("k"))
    counts = {(bool(x.r), x.k): x["count"] for x in pairs.groupBy("r", "k").count().collect()}
    out = []
    for a in range(size):
        row = {r: [counts.get((r, a * size + b), 0) + 0.5 for b in range(size)] for r in (True, False)}
        total = {r: sum(v) for r, v in row.items()}
        out += [math.log(row[True][b] / total[True]) - math.log(row[False][b] / total[False]) for b in range(size)]
    return tuple(out)


def _identifiers(words: Column) -> Column:
    """Chains of two to five words, in turn as snake, kebab, path, camel, upper snake and Pascal case, every other with a number."""

    def styled(i: Column) -> Column:
        own = F.slice(words, i * 5 + 1, 2 + i % 4)
        pascal, number, numbered = F.array_join(F.transform(own, F.initcap), ""), (i * 7919 % 1000).cast("string"), i % 4 < 2
        join = lambda mark, tag: F.lower(F.concat(F.array_join(own, mark), F.when(numbered, F.concat(F.lit(tag), number)).otherwise("")))
        camel = F.concat(F.lower(F.substring(pascal, 1, 1)), F.substr(pascal, F.lit(2)))
        return (
            F.when(i % 6 == 0, join("_", "_")).when(i % 6 == 1, join("-", "-")).when(i % 6 == 2, F.concat(F.lit("/"), join("/", "/v"))).when(i % 6 == 3, camel)
            .when(i % 6 == 4, F.upper(join("_", "_"))).otherwise(F.concat(pascal, F.when(numbered, number).otherwise("")))
        )

    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(words) / 5).cast("int") - 1, F.lit(0))), styled)


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, strings: int = SAMPLE_STRINGS) -> DataFrame:
    """``(token, random)``: ordinary words and identifiers, and ``strings`` random strings of each of four kinds.

    Ordinary are words of about ``sample_docs`` documents without what the base
    patterns find, identifiers made of these words and of ``WORDS``, numbers,
    dates and versions.
    """
    n = docs.count()
    clean = F.col(text_col)
    for pattern in (ASSIGN, ACCESS, HEX):
        clean = F.regexp_replace(clean, pattern, " ")
    picked = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample_docs / max(1, n)))).select(F.regexp_extract_all(clean, F.lit("[A-Za-z]{3,}"), F.lit(0)).alias("w"))
    seq = docs.sparkSession.range(strings).select("id", F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")).cast("binary"), 512).alias("h"))
    digit = lambda k, m, width: F.lpad((F.conv(F.substring("h", 8 * k + 1, 7), 16, 10).cast("long") % m).cast("string"), width, "0")
    day = F.concat(F.lit("20"), digit(0, 30, 2), F.lit("-"), digit(1, 12, 2), F.lit("-"), digit(2, 28, 2))
    clock = F.concat(F.lit("T"), digit(3, 24, 2), F.lit("-"), digit(4, 60, 2), F.lit("-"), digit(5, 60, 2))
    word = lambda k: F.element_at(F.array(*map(F.lit, WORDS)), (F.conv(F.substring("h", 8 * k + 1, 7), 16, 10).cast("long") % len(WORDS) + 1).cast("int"))
    dated = F.array(F.concat(day, clock, F.lit("-"), word(6), F.lit("-"), digit(7, 10000, 4)), F.concat(word(8), F.lit("/"), F.translate(day, "-", "/"), F.lit("/"), word(9), F.lit("-v"), digit(10, 20, 1)), F.concat(word(11), F.lit("_"), F.translate(day, "-", ""), F.lit("_"), digit(12, 1000000, 6)))
    made = F.array(*[word(k) for k in range(15)])
    of_words = picked.select(F.explode(F.concat("w", _identifiers(F.col("w")))).alias("token"))
    of_programs = seq.select(F.explode(F.concat(_identifiers(made), _identifiers(F.reverse(made)), dated, F.array(F.regexp_replace("h", "[a-f]", "")))).alias("token"))
    base64 = F.translate(F.base64(F.unhex("h")), "\n\r=", "")
    strings_of = seq.select(F.explode(F.array(base64, F.lower(base64), F.upper(base64), F.upper(F.substring("h", 1, 64)))).alias("token"))
    return of_words.unionByName(of_programs).select("token", F.lit(False).alias("random")).unionByName(strings_of.select("token", F.lit(True).alias("random")))


def _ratio(token: Column, table: Column) -> Column:
    size = len(ALPHABET) + 1

    def total(c: Column) -> Column:
        pairs = F.transform(c, lambda x, i: F.get(table, x * size + F.get(c, i + 1)))
        return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))

    return F.transform(F.array(_codes(token)), total)[0]


def _literal(table: tuple[float, ...]) -> Column:
    return F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")


def fitted(samples: DataFrame) -> Model:
    """Trains on four fifths of ``samples(token, random)``; the threshold lies between the ordinary and the random ones among the long rest."""
    held = F.pmod(F.xxhash64("token"), F.lit(HELD_OUT)) == 0
    table = train(samples.where(~held))
    seen = samples.where(held & F.col("token").rlike(f"^{TOKEN}$")).select("random", (_ratio(F.col("token"), _literal(table)) / F.char_length("token")).alias("r"))
    of = lambda random, q: F.percentile_approx(F.when(F.col("random") == random, F.col("r")), q, 10_000)
    high, low = seen.agg(of(False, 1 - ALARMS), of(True, MISSES)).first()
    return Model(table, max(LEAST_MEAN, high + BETWEEN * (low - high) if high is not None and low is not None else LEAST_MEAN))


def scan(docs: DataFrame, model: Model, text_col: str = "text", **keep: Column) -> DataFrame:
    """Adds ``base`` and ``spans`` to the ``keep`` columns: arrays of (start, kind, end), by start, then kind.

    A null text counts as empty and has no span; very long texts are read
    whole; an empty table gives an empty result; repeated rows each keep their
    row; columns that aren't kept may have any names. ``kind`` is a place in
    ``KINDS``; spans that the models add overlap none of the base ones.
    """
    names = list(keep)
    t = docs.select(*[c.alias(n) for n, c in keep.items()], F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    text = F.col("__t")
    base = F.sort_array(F.concat(find_spans(text, ASSIGN, 0, ASSIGN_LENGTH), find_spans(text, ACCESS, 1), find_spans(text, HEX, 2)))
    t = t.select(*names, "__t", base.alias("base"), find_spans(text, TOKEN, 3).alias("__c"))
    table = _literal(model.table)

    def secret(s: Column) -> Column:
        token = F.substr(text, s["start"] + 1, s["end"] - s["start"])
        ratio = _ratio(token, table)
        return ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) & (ratio >= F.greatest(F.lit(LEAST_TOTAL), model.mean * (s["end"] - s["start"])))

    added = F.when(F.size("__c") > 0, F.filter("__c", secret)).otherwise(F.array().cast(_SPAN))
    return t.select(*names, "__t", "base", F.when(F.size("__c") > 0, F.sort_array(F.concat("base", added))).otherwise(F.col("base")).alias("spans"))


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each span, or chain of overlapping spans, replaced by the mask."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    return fitted(labelled_samples(docs, id_col, text_col))


def listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_markov_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scan(docs, fit(docs), doc_id=F.col("doc_id"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select("doc_id", count(0), count(1), count(2), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
