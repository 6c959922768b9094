"""Small files of a run in any file system that Spark reads: manifests and events."""

from __future__ import annotations

import uuid
from threading import Lock

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_NAMING = Lock()


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _at(spark, path)
    return system.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """The sorted names in a folder; none if it doesn't exist."""
    place, system = _at(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(place)) if system.exists(place) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``."""
    place, system = _at(spark, path)
    return system.getContentSummary(place).getLength()


def delete(spark: SparkSession, path: str) -> None:
    place, system = _at(spark, path)
    system.delete(place, True)


def read(spark: SparkSession, path: str) -> str:
    place, system = _at(spark, path)
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a whole file under a name that is free; False, and nothing changed, if it is taken.

    The text goes to a hidden file that is then renamed without overwriting, so a
    reader finds all of the file or none. On a local disk, where the rename isn't
    exclusive, this holds for the writers of one driver.
    """
    folder, name = path.rsplit("/", 1)
    hidden, system = _at(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = system.create(hidden, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    rename = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    target = hadoop.Path(path)
    try:
        with _NAMING:
            context = hadoop.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
            context.rename(hidden, target, how)
        return True
    except Py4JJavaError:
        system.delete(hidden, False)
        if system.exists(target):
            return False
        raise
