"""Scalar expressions on paths, rates, labels and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """P15."""
    return F.element_at(F.split(path, "/"), -1)


def extension_list(text: Column) -> Column:
    """Comma-separated extensions, trimmed, without leading dots, lower case, no empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.regexp_replace(F.trim(x), "^\\.+", ""))), lambda x: x != "")


def extension_key(text: Column) -> Column:
    """Sorted distinct extensions in one text."""
    return F.array_join(F.array_sort(F.array_distinct(extension_list(text))), ",")


def has_extension(path: Column, extensions: Column) -> Column:
    """S3: the last dotted part, in any case."""
    return (F.instr(base_name(path), ".") > 0) & F.array_contains(extensions, F.lower(F.element_at(F.split(path, "\\."), -1)))


def parse_rate(text: Column) -> tuple[Column, Column]:
    """Numerator and denominator of ``n/d``, null unless both are numbers and d is not 0."""
    part = lambda i: F.regexp_extract(text, r"^\s*([0-9]{1,9})\s*/\s*([0-9]{1,9})\s*$", i).try_cast("long")
    ok = part(2) > 0
    return F.when(ok, part(1)), F.when(ok, part(2))


def timebase(num: Column, den: Column) -> tuple[Column, Column]:
    """Frame base and whether it is a drop-rate base."""
    drop = (den == 1001) & num.isin(24000, 30000, 60000)
    base = F.when(drop, F.round(num / 1000)).when(den == 1, num).otherwise(F.least(F.greatest(F.round(num / den), F.lit(1)), F.lit(240)))
    return base.cast("long"), drop


def duration_frames(seconds: Column, num: Column, den: Column) -> Column:
    """S13."""
    return F.greatest(F.round(seconds * num / den), F.lit(0.0)).cast("long")


def attribute_number(text: Column, name: str) -> Column:
    """Leading digits of the first ``name="..."``."""
    return F.regexp_extract(text, f'{name}="([0-9]+)', 1).try_cast("long")


def slow_motion(capture: Column, form: Column, fps: Column, marked: Column) -> Column:
    """A marker, or a capture rate of twice the format rate; a container rate of 48 and more stands in for a missing capture rate."""
    rate = F.coalesce(capture, F.when(fps >= 48, F.round(fps).cast("long")))
    return marked | F.coalesce(rate >= 2 * form, F.lit(False))


def rate_varies(avg_num: Column, avg_den: Column, num: Column, den: Column) -> Column:
    """Average and nominal rate differ by over a hundredth."""
    return F.abs(avg_num / avg_den - num / den) / (num / den) > 0.01


def seconds_to_frame(seconds: Column, base: Column) -> Column:
    """Nearest frame; negative and not-a-number give 0."""
    return F.when(F.isnan(seconds) | (seconds < 0), F.lit(0.0)).otherwise(F.round(seconds * base)).cast("long")


def label_id(kind: Column) -> Column:
    """P8. Fixed values."""
    return F.when(kind == "GimbalMove", 4).when(kind == "StaticSubject", 1).when(kind == "SlowMotion", 5).otherwise(2).cast("short")


def seconds_label(seconds: Column) -> Column:
    """``MMmSSs``."""
    s = F.greatest(F.round(seconds), F.lit(0.0)).cast("long")
    return F.format_string("%02dm%02ds", F.floor(s / 60), s % 60)


def _by_movement(kind: Column, movement: Column, names: tuple) -> Column:
    """A name for static, subject, slow motion, zoom, roll, complex and pan, asked in this order."""
    static, subject, slow, zoom, roll, tangled, pan = map(F.lit, names)
    return (
        F.when(kind == "Static", static).when((kind == "StaticSubject") | (movement == "Subject"), subject).when((kind == "SlowMotion") | (movement == "SlowMotion"), slow)
        .when(movement == "Zoom", zoom).when(movement == "Roll", roll).when(movement == "Complex", tangled).otherwise(pan)
    )


def movement_label(kind: Column, movement: Column) -> Column:
    """P11. Fixed values."""
    return _by_movement(kind, movement, ("static", "static subject", "slow motion", "zoom", "roll", "complex camera move", "pan/tilt"))


def label_colour(kind: Column, movement: Column) -> Column:
    """P12. Fixed values."""
    return _by_movement(kind, movement, ("Cerulean", "Caribbean", "Iris", "Mango", "Lavender", "Rose", "Forest"))


def clip_comment(kind: Column, movement: Column, start: Column, end: Column, prefix: str = "Selects") -> Column:
    """Movement, source times and duration with two decimals."""
    length = F.greatest(end - start, F.lit(0.0))
    return F.concat(F.lit(f"{prefix}: "), movement_label(kind, movement), F.lit(" | source in "), seconds_label(start), F.lit(" out "), seconds_label(end), F.lit(" | duration "), F.format_string("%.2f", length), F.lit("s"))


def file_url(path: Column) -> Column:
    """K6: percent-encoded components after ``file://localhost/``; a drive keeps its colon."""
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^//\?/", "")
    enc = lambda x: F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    parts = F.transform(F.split(clean, "/"), lambda x, i: F.when((i == 0) & x.rlike("^[A-Za-z]:$"), x).otherwise(enc(x)))
    return F.concat(F.lit("file://localhost/"), F.array_join(parts, "/"))


def cache_key(path: Column) -> Column:
    """Cleaned base name, then the beginning of the path's SHA-256."""
    return F.concat(F.substring(F.regexp_replace(base_name(path), "[^A-Za-z0-9._-]", ""), 1, 48), F.lit("-"), F.substring(F.sha2(path, 256), 1, 16))


def person_score(matrix: Column) -> Column:
    """A10 on an array of equally long rows: the best person, not under 0; null without five attributes.

    Attributes lie along the shorter axis if both have five or more, else along
    the rows if they are five or more, else along the columns. With 6 or at
    least 85 of them objectness counts times class, else column 4 alone.
    """
    rows, columns = F.size(matrix), F.coalesce(F.size(F.get(matrix, F.lit(0))), F.lit(0))
    by_rows = F.when((rows >= 5) & (columns >= 5), rows < columns).otherwise(rows >= 5)
    n = F.when(by_rows, rows).otherwise(columns)
    line = lambda k: F.when(by_rows, F.get(matrix, F.lit(k))).otherwise(F.transform(matrix, lambda r: F.get(r, F.lit(k))))
    scores = F.when((n == 6) | (n >= 85), F.zip_with(line(4), line(5), lambda a, b: a * b)).otherwise(line(4))
    return F.when(n >= 5, F.greatest(F.array_max(scores), F.lit(0.0)))


def distinct_lines(text: Column) -> Column:
    """The trimmed lines that aren't empty, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""))
