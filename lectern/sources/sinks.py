"""Writers; the commit protocol makes each of them atomic."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources import files

#: Spark's setting by which what was dealt goes when the action ends that dealt it.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def json_lines(rows: DataFrame, path: str) -> None:
    """Compact JSON lines, replacing what was there."""
    rows.write.mode("overwrite").json(path)


def json_document(row: DataFrame, path: str) -> None:
    """One record as one JSON file, which appears whole or not at all; nulls stay, as the record's readers expect every field."""
    found = row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("t")).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"a JSON document is one record, not {'none' if not found else 'several'}")
    files.write_text(row.sparkSession, path, found[0].t)


def corpus(rows: DataFrame, path: str) -> None:
    """A Parquet table partitioned by document."""
    rows.write.mode("overwrite").partitionBy("document_id").parquet(path)


def collection(rows: DataFrame, name: str, recreate: bool = False) -> None:
    """A table of index points; an existing one is an error unless it is recreated."""
    rows.write.mode("overwrite" if recreate else "errorifexists").saveAsTable(name)


def upsert(rows: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Append the rows whose key the table at ``path`` lacks, and return them."""
    spark = rows.sparkSession
    try:
        known = spark.read.parquet(path).select(key)
    except Exception as e:  # the table's first rows
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = rows.dropDuplicates([key])
    else:
        fresh = rows.dropDuplicates([key]).join(known, key, "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def printable(hits: DataFrame, preview) -> DataFrame:
    """``query_id, position, line``: one line for each hit."""
    return hits.select("query_id", "position", F.concat_ws("  ", F.col("position").cast("string"), F.round("score", 4).cast("string"), "chunk_id", preview).alias("line"))


def passages(contexts: DataFrame) -> DataFrame:
    """``query_id, position, line``: a head line and the text of each context."""
    pages = F.concat(F.lit("pages "), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"))
    head = F.concat_ws("  ", F.concat(F.lit("["), "context_type", F.lit("]")), "parent_id", pages, F.when(F.col("truncated"), "truncated"))
    return contexts.select("query_id", "position", F.concat_ws("\n", head, "text").alias("line"))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local master without that setting gets a folder of its machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lectern.stage.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("lectern.stage.dir", folder)
    return folder.rstrip("/")


def answers(queries: DataFrame, hits: DataFrame, contexts: DataFrame, retrieval: dict) -> DataFrame:
    """``query_id, answer``: for each query ``query_id, text`` a JSON object ``query, retrieval, hits, contexts``; hits and contexts are as few as their limits say."""

    def listed(rows: DataFrame, name: str) -> DataFrame:
        own = F.struct(*(c for c in rows.columns if c != "query_id"))
        return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", own.alias("row")))).alias("_rows")).select("query_id", F.transform("_rows", lambda r: r["row"]).alias(name))

    joined = queries.join(listed(hits, "hits"), "query_id", "left").join(listed(contexts, "contexts"), "query_id", "left")
    lists = [F.coalesce(c, F.array()).alias(c) for c in ("hits", "contexts")]
    how = F.struct(*(F.lit(v).alias(k) for k, v in retrieval.items()))
    return joined.select("query_id", F.to_json(F.struct(F.col("text").alias("query"), how.alias("retrieval"), *lists), {"ignoreNullFields": "false"}).alias("answer"))


def own_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Tables written within it leave no shuffle files behind, which otherwise lie there until the driver collects garbage."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)


def release(rows: DataFrame) -> None:
    """Take the files of a ``stage`` away, which nothing reads any more."""
    spark, (path, name) = rows.sparkSession, rows._staged
    if name is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _tables.remove((spark, name))
    files.remove(spark, path)
    _staged.remove((spark, path))


def stage(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Write a stage's result into the shared folder and read it back, so later stages do not compute it again.

    With ``by`` it is a table in buckets of that column: what is grouped, ordered
    or joined by it (and more) later is not dealt again.  The files go with ``release``
    or when the driver ends.
    """
    spark = rows.sparkSession
    path = own_folder(spark, "stage")
    if by is None:
        with tidy(spark):
            rows.write.option("compression", "zstd").parquet(path)
        found = spark.read.schema(rows.schema).parquet(path)
        found._staged = path, None
        return found
    name, buckets = f"lectern_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    _tables.append((spark, name))
    # joins by the column and more than it find both sides in place; by default all their keys must be those of the buckets
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    with tidy(spark):
        dealt(rows, by).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, by).saveAsTable(name)
    found = spark.table(name)
    found._staged = path, name
    return found


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """Rows dealt by a column, as the buckets of ``stage`` are; rows that lie so already stay where they are."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


_staged: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_staged() -> None:
    for spark, name in _tables:
        with contextlib.suppress(Exception):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    for spark, path in _staged:
        with contextlib.suppress(Exception):  # the session may have ended before
            files.remove(spark, path)
