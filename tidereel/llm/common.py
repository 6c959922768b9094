"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII blanks; ``bytes.split()`` cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder."""
    context = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and context.getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return named or context.getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage with a Parquet table in the checkpoint folder: smaller than a checkpoint where many rows are alike."""
    folder = f"{_shared(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the folder that the session names.

    A folder is made up only on a local master where neither
    ``spark.checkpoint.dir`` nor a checkpoint folder is set, as in tests.
    """
    _shared(df.sparkSession)
    return df.checkpoint()


def text_bytes(name: str = "text") -> Column:
    """The whole text as UTF-8 bytes; a null text is an empty one."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
