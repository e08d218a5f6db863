"""Files that exist once: what batches and snapshots are committed by. Nothing here reads or moves rows."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Creates the file with this text; false, and nothing changed, where it is there already."""
    fs, at = _file(spark, path)
    if fs.exists(at):
        return False
    try:
        out = fs.create(at, False)
    except Exception as e:  # another writer was first
        if fs.exists(at):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def held(spark: SparkSession, path: str) -> str | None:
    """Text of the file; empty where its writer died before the end, None where there is no file."""
    fs, at = _file(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files of a folder, in order; none where there is no folder."""
    fs, at = _file(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def discard(spark: SparkSession, path: str) -> None:
    fs, at = _file(spark, path)
    fs.delete(at, False)
