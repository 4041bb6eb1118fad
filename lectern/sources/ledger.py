"""Which files changed: a ledger of digests, against which folders are compared before any of their text is read.

A ledger is a folder with one Parquet table for each version and a file that
names the current one, replaced by a rename; a run that fails leaves the last
version.  A file whose path, length and modification time are known is taken
to be what it was and is not opened; of the others the digest decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources import files, readers

COLUMNS = "path string, length long, modified timestamp, sha256 string"
CURRENT = "current"


def known(spark: SparkSession, ledger: str) -> DataFrame:
    """``path, length, modified, sha256`` as last recorded; none before the first time."""
    if not files.exists(spark, f"{ledger}/{CURRENT}"):
        return spark.createDataFrame([], COLUMNS)
    return spark.read.schema(COLUMNS).parquet(f"{ledger}/{files.read_text(spark, f'{ledger}/{CURRENT}')}")


def changes(spark: SparkSession, path: str, ledger: str) -> DataFrame:
    """``path, length, modified, sha256, change``: files that are ``new``, ``changed`` or ``gone``, and those only ``touched``."""
    old = known(spark, ledger).withColumnsRenamed({"length": "old_length", "modified": "old_modified", "sha256": "old_sha256"})
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    # the listing alone: no file is opened for it
    rest = seen.join(old, ["path"], "full_outer").filter("old_length IS NULL OR length IS NULL OR old_length <> length OR old_modified <> modified")
    gone = rest.filter("length IS NULL").select("path", F.col("old_length").alias("length"), F.col("old_modified").alias("modified"), F.col("old_sha256").alias("sha256"), F.lit("gone").alias("change"))
    # the first time everything is read; later the names of what differs go to the reader
    first = not files.exists(spark, f"{ledger}/{CURRENT}")
    opened = [path] if first else [r.path for r in rest.filter("length IS NOT NULL").select("path").toLocalIterator()]
    if not opened:
        return gone
    digests = readers.file_digests(spark, opened).select("path", "sha256")
    now = rest.filter("length IS NOT NULL").join(digests, "path")
    change = F.when(F.col("old_sha256").isNull(), "new").when(F.col("old_sha256") == F.col("sha256"), "touched").otherwise("changed")
    return now.select("path", "length", "modified", "sha256", change.alias("change")).unionByName(gone)


def record(found: DataFrame, ledger: str) -> None:
    """Put ``changes`` into the ledger; the version before the last is removed."""
    spark = found.sparkSession
    version = int(files.read_text(spark, f"{ledger}/{CURRENT}").removeprefix("version=")) + 1 if files.exists(spark, f"{ledger}/{CURRENT}") else 1
    kept = known(spark, ledger).join(found.select("path"), "path", "left_anti")
    kept.unionByName(found.filter("change <> 'gone'").drop("change")).write.mode("overwrite").parquet(f"{ledger}/version={version}")
    files.write_text(spark, f"{ledger}/{CURRENT}", f"version={version}")
    files.remove(spark, f"{ledger}/version={version - 2}")
