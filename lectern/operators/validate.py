"""Corpus checks and index reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T


class CorpusError(ValueError):
    """A corpus breaks a rule of the data model."""


def violations(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``rule, id`` of every breach: ids present and unique, parents resolvable, texts not empty."""
    missing = lambda df, c, rule: df.filter(F.col(c).isNull() | (T.strip(F.col(c)) == "")).select(F.lit(rule).alias("rule"), F.lit("").alias("id"))
    twice = lambda df, c, rule: df.filter(F.col(c).isNotNull()).groupBy(c).count().filter("count > 1").select(F.lit(rule).alias("rule"), F.col(c).alias("id"))
    parts = [
        missing(parents, "parent_id", "parent-without-id"),
        twice(parents, "parent_id", "parent-id-twice"),
        missing(chunks, "chunk_id", "chunk-without-id"),
        twice(chunks, "chunk_id", "chunk-id-twice"),
        missing(chunks, "parent_id", "chunk-without-parent-id"),
        orphans(parents, chunks).select(F.lit("parent-unknown").alias("rule"), F.col("chunk_id").alias("id")),
        chunks.filter(F.coalesce(T.strip(F.col("text")), F.lit("")) == "").select(F.lit("chunk-without-text").alias("rule"), F.coalesce("chunk_id", F.lit("")).alias("id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphans(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose parent does not exist."""
    return chunks.filter("parent_id IS NOT NULL").join(parents.select("parent_id").filter("parent_id IS NOT NULL"), "parent_id", "left_anti")


def validate(parents: DataFrame, chunks: DataFrame) -> None:
    """Raise for the first breach."""
    worst = violations(parents, chunks).orderBy("rule", "id").first()
    if worst is not None:
        raise CorpusError(f"{worst.rule}: {worst.id}")


def unknown_ids(wanted: DataFrame, known: DataFrame, column: str = "document_id") -> DataFrame:
    """Selected ids that do not exist."""
    return wanted.select(column).distinct().join(known.select(column), column, "left_anti")


def index_report(parents: DataFrame, chunks: DataFrame, lengths: DataFrame, dimension: int) -> DataFrame:
    """One row: documents, parents, chunks, average lexical length, dense dimension."""
    docs = chunks.agg(F.count_distinct("document_id").alias("document_count"), F.count("*").alias("chunk_count"))
    ups = parents.agg(F.count("*").alias("parent_count"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    rows = one(docs).join(one(ups), "_one").join(one(lengths), "_one").drop("_one")
    return rows.select("document_count", "parent_count", "chunk_count", F.bround("avg_length", 4).alias("average_lexical_length"), F.lit(dimension).alias("dense_dimension"))
