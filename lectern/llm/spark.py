"""Session helpers of this package."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.words import release

#: Bytes of one Arrow batch that goes to Python, where the session has Spark's own default.
BATCH_BYTES, DEFAULT_BATCH_BYTES = 8 << 20, 64 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Folders written by ``settle`` that are not discarded yet.
_settled: dict[str, SparkSession] = {}
_tables: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, from ``spark.checkpoint.dir``.

    Without that setting a local master gets a temporary folder of its machine,
    once per session; a cluster gets an error, since no folder is known there
    that all its machines see.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lectern.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
        found = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("lectern.shared.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, light: bool = False) -> DataFrame:
    """Write the rows once into the shared folder and read them back.

    ``light`` rows (ids and numbers) go into an eighth as many files as there
    are shuffle partitions, since every later read opens them all.

    This cuts the lineage with files that survive the loss of an executor,
    and keeps an expensive stage from running again for each later use.
    ``discard`` removes the files when nothing will read them any more; what
    is left goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    _settled[path] = spark
    rows = df.coalesce(max(1, shuffle_width(spark) // 8)) if light else df
    rows.write.option("compression", "zstd").parquet(path)
    let_go(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def settle_bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Like ``settle``, as a bucketed table: grouping by ``column`` needs no further shuffle.

    The table is external, in the shared folder, under a name of its own, and
    leaves the catalogue with its files.
    """
    spark = df.sparkSession
    name = f"lectern_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    _settled[path], _tables[path] = spark, name
    dealt = df.repartition(buckets, column)
    dealt.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column).sortBy(column).saveAsTable(name)
    let_go(spark)
    out = spark.table(name)
    out.settled_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the files of settled frames; nothing derived from them may be computed afterwards."""
    for df in frames:
        _remove(df.settled_path)


def _remove(path: str) -> None:
    spark = _settled.pop(path)
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_all() -> None:
    for path in list(_settled):
        with contextlib.suppress(Exception):  # the session may have ended before
            _remove(path)


def let_go(spark: SparkSession) -> None:
    """Shuffle files of finished jobs are removed when the driver collects its garbage; ask for that."""
    spark.sparkContext._jvm.System.gc()


def in_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` with batches of bounded bytes and workers that give back memory after each."""
    conf = rows.sparkSession.conf
    if int(conf.get(_BATCH, str(DEFAULT_BATCH_BYTES)).rstrip("b")) == DEFAULT_BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                release()

        yield from run(watched())
        release()

    return rows.mapInArrow(bounded, schema)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups_for(df: DataFrame, size: int) -> int:
    """Groups of about ``size`` bytes for the rows of ``df``, by Spark's estimate of their size, and some for each shuffle partition at least."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # without statistics Spark reports a number near the largest long
    return max(4 * shuffle_width(df.sparkSession), -(-estimate // size) if estimate < 1 << 60 else 0)
