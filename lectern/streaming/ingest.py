"""Incremental indexing of chunk files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from lectern.operators.chunking import deduplicate
from lectern.sources.sinks import upsert


def new_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def index(stream: DataFrame, target: str, checkpoint: str, key: str = "content_hash") -> StreamingQuery:
    """Write each chunk whose content is not yet in ``target`` once; a repeated batch adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        upsert(deduplicate(batch, "chunk_id", scope=()), target, key)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
