"""From raw documents to token ids: quality rules, near-duplicate removal, secret redaction, source mixing, BPE.

Each stage takes ``(spark, docs, sf_dir)`` and gives the columns of
``documents``, but for the last. ``run`` writes each stage as Parquet in the
shared folder and reads it again. All stages accept nulls in any column,
empty texts and tables, and extra columns, which they leave behind.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidereel.llm import bpe, mixing, nearcopies, quality, secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle, and tenths of Jaccard similarity from which two documents are near copies.
SHINGLE, TENTHS = 5, 8
#: Words that a Python worker of the last stage remembers; it lives on in other stages' tasks.
MEMO_WORDS = 100_000


def _digest() -> Column:
    return F.md5(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")))


def _key() -> Column:
    """Id and digest of the text in one string; only rows with both alike share it."""
    return F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), F.lit("#"), _digest())


def _row_key(docs: DataFrame) -> Column:
    """Id and digest of the text, without nulls; rows without an id come last."""
    none = F.lit("0").cast(docs.schema["doc_id"].dataType)
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", none).alias("doc_id"), _digest().alias("text"))


def _one_row_each(docs: DataFrame) -> DataFrame:
    """Drops rows that repeat both id and text, if there are any: the usual table isn't shuffled for that."""
    repeated = docs.select(_key().alias("k")).groupBy("k").count().where("count > 1").limit(1)
    if not repeated.collect():
        return docs
    return docs.withColumn("__k", _key()).dropDuplicates(["__k"]).drop("__k")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others keep the lines that pass."""
    judged = quality.verdict(quality.measure(docs, **{f"k_{c}": F.col(c) for c in COLUMNS}))
    return judged.where("kept").select(F.col("k_doc_id").alias("doc_id"), F.col("kept_text").alias("text"), F.col("k_lang").alias("lang"), F.col("k_source").alias("source"), F.char_length("kept_text").cast("long").alias("n_chars"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id stays of each near-duplicate group; one without an id only where none has one.

    Links of the vantage-point search and of MinHash bands are verified by the
    similarity of their shingles; see ``nearcopies``.
    """
    keyed = docs.select(*COLUMNS, _row_key(docs).alias("id"))
    kept = nearcopies.near_copies(keyed, SHINGLE, TENTHS).select("id")
    return _one_row_each(keyed.join(kept, "id", "left_semi").select(*COLUMNS)).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; every document stays."""
    found = secrets.scan(docs, secrets.fit(docs), **{f"k_{c}": F.col(c) for c in COLUMNS})
    clean = found.select(*[F.col(f"k_{c}").alias(c) for c in COLUMNS if c not in ("text", "n_chars")], secrets.redact(F.col("__t"), F.col("spans")).alias("text"))
    return clean.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    docs = _one_row_each(docs.select(*COLUMNS))
    taken = mixing.mix(docs.select(_key().alias("id"), "source", mixing.n_words().alias("size"))).where("copies > 0").select(F.col("id").alias("__k"), "copies")
    rows = docs.withColumn("__k", _key()).join(taken, "__k")
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies")).alias("__c")).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) and a digest of what they decode to."""
    out = bpe.encode_decode(docs, *bpe.vocabulary(), memo_words=MEMO_WORDS)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: MinHash bands, random draws and merges have no SQL; tests hold near_dedup, mixing and bpe against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="pipeline-")
    folder, docs = f"{shared}/pipeline-{uuid.uuid4()}", spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
