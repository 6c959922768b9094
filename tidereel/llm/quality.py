"""Quality rules, line first: failing lines go, then documents that lose too much.

Everything is a column expression; texts are never cut or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[ \x09-\x0D]+"
#: A document is rejected if over this share of its words is in removed lines.
MOST_REMOVED = 0.5
#: A line of fewer words needs a final mark to count as prose; menus have a separator for so many words.
SHORT_LINE, MENU_WORDS = 4, 3
FINAL_MARK = r"[.!?…:;。！？»”\"'\)\]][ \x09-\x0D]*$"
#: Phrases of page furniture, compared in lower case.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "cookie settings", "we use cookies", "accept cookies",
    "click here", "subscribe now", "subscribe to our", "sign up for", "enable javascript", "back to top", "skip to content", "skip to main content", "lorem ipsum", "powered by ",
)
MENU = r"[|»›•·]"
SYMBOL = r"[#*$%&|<>]"
#: Symbols for each word at which a line is noise.
NOISE = 0.5


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def has_phrase(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for p in BOILERPLATE:
        out = out | low.contains(p)
    return out


def fails_line(line: Column, marked: Column, boiler: Column) -> Column:
    """True if a line is a menu, symbol noise, boilerplate, or a scrap without final punctuation. Blank lines do not fail.

    ``marked`` and ``boiler`` tell whether the text has any such mark or phrase at all.
    """

    def judge(n: Column) -> Column:
        menu = F.regexp_count(line, F.lit(MENU)) * MENU_WORDS >= n
        noise = F.regexp_count(line, F.lit(SYMBOL)) >= n * NOISE
        return (n > 0) & ((marked & ((line.rlike(MENU) & menu) | noise)) | ((n < SHORT_LINE) & ~line.rlike(FINAL_MARK)) | (boiler & has_phrase(line)))

    return F.transform(F.array(F.size(words_of(line))), judge)[0]  # counts the words once


def _repeat_words(hashes: Column, window: int) -> Column:
    """Positions covered by windows whose hash comes twice or more; ``hashes`` in order of position."""
    tagged = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.transform(
        F.array(tagged),  # binds the sorted array once
        lambda s: F.transform(
            F.array(F.sort_array(F.transform(F.filter(s, lambda e, k: (F.get(s, k - 1)["x"] == e["x"]) | (F.get(s, k + 1)["x"] == e["x"])), lambda e: e["i"]))),
            lambda p: F.aggregate(F.transform(p, lambda at, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - at, F.lit(window)))), F.lit(0).cast("long"), lambda a, b: a + b),
        ),
    )[0][0]


def measure(docs: DataFrame, text_col: str = "text", window: int = 5, **keep: Column) -> DataFrame:
    """Adds to the ``keep`` columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed, kept_text.

    A null text has no word, line or symbol; its kept_text is empty. An empty
    table gives no row, repeated rows each keep theirs, columns that aren't
    kept may have any names, and very long texts are read whole. Repeated
    windows are found by XXH64 of their words; work and memory are those of
    sorting one document's windows, and only where some repeat.
    """
    names = list(keep)
    t = docs.select(*[c.alias(n) for n, c in keep.items()], F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    t = t.select(*names, "__t", words_of(F.col("__t")).alias("__w"), F.split("__t", "\n").alias("__l"), F.col("__t").rlike(r"[#*$%&|<>»›•·]").alias("__m"), has_phrase(F.col("__t")).alias("__b"))
    w, n = F.col("__w"), F.size("__w")
    hashes = F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))).otherwise(F.array().cast("array<bigint>"))
    worded = F.filter("__l", lambda x: x.rlike(r"[^ \x09-\x0D]"))
    t = t.select(*names, "__t", "__l", n.cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), hashes.alias("__h"), worded.alias("__d"), F.transform("__l", lambda x: fails_line(x, F.col("__m"), F.col("__b"))).alias("__f"), "__m")
    h, lines, fails = F.col("__h"), F.col("__l"), F.col("__f")
    removed = F.aggregate(F.filter(lines, lambda x, i: F.get(fails, i)), F.lit(0), lambda a, x: a + F.size(words_of(x)))
    measures = F.struct(
        "n_words",
        "word_chars",
        F.when(F.col("__m"), F.regexp_count(F.col("__t"), F.lit(SYMBOL))).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("__d") - F.size(F.array_distinct("__d"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_repeat_words(h, window)).alias("n_repeat_words"),
        removed.cast("long").alias("n_removed"),
        F.array_join(F.filter(lines, lambda x, i: ~F.get(fails, i)), "\n").alias("kept_text"),
    )
    # a generator, so that a later filter isn't pushed below with all of these expressions copied into it
    return t.select(*names, F.explode(F.array(measures)).alias("__x")).select(*names, "__x.*")


def verdict(measured: DataFrame, most_removed: float = MOST_REMOVED) -> DataFrame:
    """Adds base_failed and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.select("*", failed.alias("base_failed"), (~failed & (F.col("n_removed") <= F.col("n_words") * most_removed)).alias("kept"))


def op8_line_quality(spark, sf_dir: str) -> DataFrame:
    """Base measures and verdict of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = verdict(measure(docs, doc_id=F.col("doc_id")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")
