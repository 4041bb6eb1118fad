"""Content-addressed WARC archive.

Writing puts each distinct payload once into a payload store, keyed by its
SHA-256 and verified against length and SHA-1, and the exact header block of
every record into a record store.  Reading joins the two stores again,
rebuilds each record's bytes and takes lengths, digests and record types from
what was read.

A null payload counts as empty.  Payloads under ``LEAST_SHARED`` bytes are
always responses of their own.  Of equal larger payloads the record with the
largest page id is the response and the others are revisits of it; rows that
repeat that page id are responses too, and a null page id is the smallest.
Header values have line breaks replaced by spaces.  An empty table gives empty
stores.  Columns besides ``page_id``, ``url`` and ``html`` are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.spark import settle, shared_dir

LEAST_SHARED = 1000
#: Rows of one payload that go to one join key; hotter payloads are spread over more.
ROWS_PER_KEY = 256
#: Header lines of the record format.
VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"


def _clean(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[\\r\\n]+", " ")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def header(page_id: Column, url: Column, kind: Column, refers_to: Column, sha1: Column, sha256: Column, size: Column) -> Column:
    """The header block of a record, up to and with its empty line."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    return F.concat(
        F.lit(VERSION + "\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_id(page_id)),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", _clean(url)),
        F.when(kind == "revisit", line("WARC-Refers-To", record_id(refers_to))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), sha256)),
        line("WARC-Payload-Length", size.cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(size.cast("string"))),
        F.lit("\r\n"),
    )


def write(pages: DataFrame, path: str, least: int = LEAST_SHARED) -> None:
    """Write ``path/records`` (page id, header, digest, join key) and ``path/payloads`` (digest, join key range, bytes)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", F.octet_length(payload).cast("long").alias("size"), F.sha2(payload, 256).alias("sha256"), F.sha1(payload).alias("sha1"), F.xxhash64(payload).alias("check"))
    keyed = settle(keyed)
    # equal SHA-256 with another length or SHA-1 would be a collision: such payloads stay apart
    address = F.concat_ws(":", "sha256", "sha1", F.col("size").cast("string"))
    keyed = keyed.withColumn("address", F.when(F.col("size") >= least, address).otherwise(F.concat(address, F.lit("@"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))))
    groups = keyed.groupBy("address").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).withColumn("keys", F.ceil(F.col("n") / ROWS_PER_KEY).cast("int"))
    groups = settle(groups, light=True)
    shared = groups.filter("n > 1").select("address", "holder", "keys")
    row = keyed.join(shared, "address", "left").withColumn("keys", F.coalesce("keys", F.lit(1)))
    row = row.withColumn("holder", F.coalesce("holder", "page_id"))
    kind = F.when(F.col("page_id").eqNullSafe(F.col("holder")) | (F.col("size") < least), "response").otherwise("revisit")
    row = row.withColumn("kind", kind)
    block = header(F.col("page_id"), F.col("url"), F.col("kind"), F.col("holder"), F.col("sha1"), F.col("sha256"), F.col("size"))
    salt = F.pmod(F.xxhash64("page_id"), F.col("keys")).cast("int")
    row.select("page_id", block.cast("binary").alias("header"), "address", salt.alias("salt")).write.option("compression", "zstd").parquet(f"{path}/records")
    # one holder of each address hands in its bytes
    holders = groups.select(F.col("holder").alias("page_id"), "address", "keys")
    body = pages.select("page_id", payload.alias("payload"))
    address_of = F.concat_ws(":", F.sha2("payload", 256), F.sha1("payload"), F.octet_length("payload").cast("string"))
    stored = body.join(holders, body.page_id.eqNullSafe(holders.page_id)).filter(F.substring_index("address", "@", 1) == address_of)
    stored = stored.select("address", "keys", "payload")
    twice = keyed.groupBy("page_id").count().filter("count > 1").limit(1).count() > 0
    (stored.dropDuplicates(["address"]) if twice else stored).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records rebuilt from both stores: ``page_id, header, payload, record``.

    ``record`` has a record's bytes: its header, its block (the payload of a
    response, nothing for a revisit) and two line ends.  ``payload`` is the
    page's content, which a revisit shares with the record it refers to.
    """
    records = spark.read.parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads").select("address", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("salt"), "payload")
    block = F.when(field(F.col("header").cast("string"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    rebuilt = F.concat("header", block, F.lit(b"\r\n\r\n"))
    return records.join(payloads, ["address", "salt"], "left").select("page_id", "header", "payload", rebuilt.alias("record"))


def field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)", 1)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archive, read it back and describe each record.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to`` and
    ``verified``: the digests and length of the bytes read equal the header's.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    head = F.col("header").cast("string")
    size, sha1 = F.octet_length("payload").cast("long"), F.sha1("payload")
    target = F.regexp_extract(field(head, "WARC-Refers-To"), "<urn:page:(-?[0-9]+)>", 1)
    verified = (field(head, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), sha1)) & (field(head, "WARC-Payload-Length") == size.cast("string"))
    return read(spark, path).select(
        "page_id",
        size.alias("payload_bytes"),
        sha1.alias("payload_digest"),
        field(head, "WARC-Type").alias("record_type"),
        F.when(target != "", target).cast("long").alias("refers_to"),
        F.coalesce(verified, F.lit(False)).alias("verified"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS size FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS holder FROM p)
SELECT page_id, size::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN size < 1000 OR page_id IS NOT DISTINCT FROM holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN size < 1000 OR page_id IS NOT DISTINCT FROM holder THEN NULL ELSE holder END AS refers_to, TRUE AS verified
FROM h
"""
