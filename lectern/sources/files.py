"""Small files and folders through the file systems that Spark knows."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    at, fs = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    """The text of one small file."""
    at, fs = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file that appears whole, or not at all: written beside its place, then renamed over what was there."""
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    at, fs = _at(spark, aside)
    try:
        stream = fs.create(at, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        jvm, (there, _) = spark._jvm, _at(spark, path)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        ways = spark.sparkContext._gateway.new_array(rename, 1)
        ways[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(at), fs.makeQualified(there), ways)
    finally:
        if fs.exists(at):
            fs.delete(at, False)
