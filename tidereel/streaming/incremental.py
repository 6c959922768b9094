"""Continuous runs: new files of a folder pass through a batch function into the result store."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidereel.sources import store


def run_new(spark: SparkSession, folder: str, schema: str, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Analyses what came since the last call; ``analyse`` gives rows with ``fingerprint``. The checkpoint remembers the files."""

    def batch(rows: DataFrame, number: int) -> None:
        store.append(analyse(rows), out, name, number)  # a batch that is tried again is stored once

    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
