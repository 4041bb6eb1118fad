"""Encoders as a stage of their own: a model fitted on a sample, sent to each worker once, applied in batches.

``Projection`` turns term counts into dense vectors by latent semantic analysis:
terms are hashed into ``PLACES`` places, weighted by how few texts of the sample
have them, and projected on the main directions of the sample.  Documents and
queries have entry points of their own: documents by the roots of their counts,
queries by their terms alone, each once.

The sample is at most about ``SAMPLE`` texts, those with the least hashes of
their keys, so a fit does not depend on how rows are dealt.  A null or empty text,
and one without a term that the sample has, gets the zero vector, which is
similar to nothing; rows without a key are left out; repeated keys give repeated
rows.  A very long text takes memory in proportion to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import retrieval

#: Places of hashed terms, vectors' length, texts of a sample, rows of a batch.
PLACES, DIMENSION, SAMPLE, BATCH = 2048, 64, 4000, 256


def counts(lists: pa.Array, once: bool) -> np.ndarray:
    """A row for each list of terms: the roots of its counts by place, or 1 where it has a term at all."""
    flat = lists.flatten().dictionary_encode()
    place = np.array([zlib.crc32(t.encode()) % PLACES for t in flat.dictionary.to_pylist()], np.int64)
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    out = np.zeros((len(lists), PLACES))
    np.add.at(out, (owner, place[flat.indices.to_numpy()] if len(place) else owner), 1.0)
    return np.minimum(out, 1.0) if once else np.sqrt(out)


@dataclass(frozen=True)
class Projection:
    """``weight`` of each place and the ``axes`` (places by dimensions)."""

    weight: np.ndarray
    axes: np.ndarray
    language: str | None = None
    batch: int = BATCH
    name: str = "latent-terms"

    def vectors(self, lists: pa.Array, once: bool) -> np.ndarray:
        x = (counts(lists, once) * self.weight) @ self.axes
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(length > 1e-12, x / np.maximum(length, 1e-300), 0.0)

    def _encode(self, texts: DataFrame, key: str, text: str, once: bool) -> DataFrame:
        sent = texts.sparkSession.sparkContext.broadcast(self)  # of a fixed size, read once by each worker
        kind = texts.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for rows in batches:
                for a in range(0, rows.num_rows, model.batch):
                    part = rows.slice(a, model.batch)
                    x = model.vectors(pa.concat_arrays([part.column(1)]), once)
                    flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
                    yield pa.RecordBatch.from_arrays([part.column(0), flat], [key, "embedding"])

        terms = F.coalesce(retrieval.terms(F.col(text), self.language), F.array().cast("array<string>"))
        return texts.filter(F.col(key).isNotNull()).select(key, terms.alias("terms")).mapInArrow(run, f"{key} {kind}, embedding array<double>")

    def documents(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        """``key, embedding`` of documents."""
        return self._encode(texts, key, text, False)

    #: as ``index.carries`` marks it
    documents.carries = True

    def queries(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        """``key, embedding`` of queries."""
        return self._encode(texts, key, text, True)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(k, float(w), axis) for k, (w, axis) in enumerate(zip(self.weight, self.axes.tolist()))]
        spark.createDataFrame(rows, "place int, weight double, axis array<double>").withColumn("language", F.lit(self.language).cast("string")).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, batch: int = BATCH) -> Projection:
    """A saved model: ``PLACES`` rows."""
    rows = spark.read.parquet(path).orderBy("place").collect()
    return Projection(np.array([r.weight for r in rows]), np.array([r.axis for r in rows]), rows[0].language, batch)


def fit(texts: DataFrame, key: str, text: str, dimension: int = DIMENSION, language: str | None = None, sample: int = SAMPLE, batch: int = BATCH) -> Projection:
    """The main directions of a sample of ``key, text``; no texts give a model that knows no term."""
    n = texts.count()
    share = min(1.0, sample / max(n, 1))
    chosen = texts.filter(F.col(text).isNotNull()).withColumn("_h", F.xxhash64(F.col(key).cast("string"))).filter(F.col("_h").bitwiseAND((1 << 40) - 1) <= int(share * ((1 << 40) - 1)))
    own = F.array_sort(F.array_distinct(retrieval.terms(F.col(text), language)))
    lists = chosen.select("_h", F.col(key).alias("_k"), own.alias("w")).orderBy("_h", "_k", "w").select("w").toArrow().column(0).combine_chunks()
    x = counts(lists, True) if len(lists) else np.zeros((0, PLACES))
    df = x.sum(axis=0)
    weight = np.where(df > 0, np.log1p(len(x) / np.maximum(df, 1)), 0.0)
    # directions of the places: eigenvectors of their products, with signs that do not depend on the solver
    values, axes = np.linalg.eigh((x * weight).T @ (x * weight))
    axes = axes[:, np.argsort(-values, kind="stable")[:dimension]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return Projection(weight, np.where(values[-1] > 0, axes, 0.0), language, batch)
