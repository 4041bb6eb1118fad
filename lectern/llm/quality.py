"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives a dozen statistics (length, symbols, capitals, repetition),
transformed to be near Gaussian.  The two classes' covariances are shrunk
towards their pooled covariance and its diagonal; the score is the logistic of
the difference of the two Mahalanobis log-densities, with cached Cholesky
factors.  Fitting sums counts, sums and outer products over at most
``TRAINING_ROWS`` labelled rows of the training fold, those with the least
hashes of their ids; the driver sees a few hundred numbers.

Null and empty texts have the statistics of a text without words and are
scored like any other row.  Rows of ``labels`` with nulls are passed over;
repeated labels count as often as they occur.  Without labels of both classes
each score is the share of label 1 (0.5 without labels).  A row whose
``doc_id`` is null counts as not held out.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.spark import in_arrow, settle
from lectern.llm.words import hash_words, slices, split_words, windows

FEATURES = ("words", "word_length", "symbols", "bars", "bangs", "capitals", "digits", "stops", "distinct", "bigrams", "lines", "line_copies")
DIM = len(FEATURES)
THRESHOLD = 0.7

#: Labelled rows that the model is fitted on at most (16 bytes each are sent to all tasks).
TRAINING_ROWS = 100_000
#: Shrinkage of a class covariance towards the pooled one, and of that towards its diagonal.
TO_POOLED, TO_DIAGONAL = 0.1, 0.05

_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"#*$%&<>^~=+", b"|", b"!?", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:"), 1):
    _CLASS[list(_chars)] = _k


def held_out(doc_id: Column) -> Column:
    """True for a quarter of the documents, by id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _copies(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of distinct values in each range of ``off``."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    key = h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[first], minlength=len(off) - 1)


def features(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    n = len(texts)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    raw = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, n], texts.cast(pa.string())), "")[0].as_buffer(), np.uint8) if n else np.zeros(0, np.uint8)
    kind = _CLASS[raw]
    doc = np.repeat(np.arange(n), size)
    count = np.bincount(doc * 8 + kind, minlength=8 * n).reshape(n, 8) if n else np.zeros((0, 8))
    flat, off = split_words(texts)
    h = hash_words(flat)
    words = np.diff(off)
    distinct = _copies(h, off)
    pair = windows(h, 2)
    inside = np.ones(len(pair), bool)
    inside[(off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(h))] - 1)] = False
    pairs = np.maximum(words - 1, 0)
    pair_distinct = _copies(pair[inside], np.concatenate([[0], np.cumsum(pairs)]))
    lines = pc.split_pattern(texts, "\n")
    line_off = lines.offsets.to_numpy().astype(np.int64)
    line_off = line_off - line_off[0]
    line_count = np.diff(line_off)
    line_distinct = _copies(hash_words(lines.flatten()), line_off)
    letters = np.diff(np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False))])[off]) if len(flat) else np.zeros(n)
    scaled = lambda x: np.log1p(200 * x)
    return np.stack(
        [
            np.log1p(words),
            np.log1p(_share(letters, words)),
            scaled(_share(count[:, 1], size)),
            scaled(_share(count[:, 2], size)),
            scaled(_share(count[:, 3], size)),
            scaled(_share(count[:, 4], size)),
            scaled(_share(count[:, 5], size)),
            scaled(_share(count[:, 6], size)),
            np.log1p(20 * (1 - _share(distinct, words))) / np.log1p(np.log1p(words) + 1),
            scaled(1 - _share(pair_distinct, pairs) * (pairs > 0) - (pairs == 0)),
            np.log1p(_share(words, line_count)),
            scaled(1 - _share(line_distinct, line_count)),
        ],
        axis=1,
    ).astype(np.float64)


def featurise(docs: DataFrame) -> DataFrame:
    """``doc_id, x array<double>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text"))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), DIM).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "x"])

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Quadratic:
    """Means, inverse Cholesky factors (lower triangles) and log determinants of both classes; none if only ``prior`` is known."""

    prior: float
    mean: np.ndarray | None = None
    whiten: np.ndarray | None = None
    logdet: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.prior)
        density = [-0.5 * ((((x - self.mean[k]) @ self.whiten[k].T) ** 2).sum(1) + self.logdet[k]) for k in (0, 1)]
        z = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _inverse(lower: np.ndarray) -> np.ndarray:
    """Inverse of a lower triangle, row by row."""
    out = np.zeros_like(lower)
    for i in range(len(lower)):
        out[i, i] = 1 / lower[i, i]
        out[i, :i] = -lower[i, :i] @ out[:i, :i] / lower[i, i]
    return out


def from_sums(sums: dict[int, np.ndarray], dim: int = DIM) -> Quadratic:
    """The model from each class's [n, sum x, sum x x'] in one vector."""
    n = {k: float(sums[k][0]) if k in sums else 0.0 for k in (0, 1)}
    if min(n.values()) < 2:
        return Quadratic(n[1] / sum(n.values()) if sum(n.values()) else 0.5)
    mean = np.stack([sums[k][1 : 1 + dim] / n[k] for k in (0, 1)])
    scatter = [sums[k][1 + dim :].reshape(dim, dim) - n[k] * np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = sum(scatter) / sum(n.values())
    pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled)) + 1e-3 * np.eye(dim)
    chol = np.stack([np.linalg.cholesky((1 - TO_POOLED) * scatter[k] / n[k] + TO_POOLED * pooled) for k in (0, 1)])
    logdet = np.array([2 * np.log(np.diag(c)).sum() for c in chol])
    return Quadratic(n[1] / sum(n.values()), mean, np.stack([_inverse(c) for c in chol]), logdet)


def training_rows(labels: DataFrame, most: int = TRAINING_ROWS) -> DataFrame:
    """``doc_id, label`` of at most ``most`` labelled rows outside the held-out fold, by least id hash; small enough for a broadcast."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "label")
    return F.broadcast(rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most))


def fit(train: DataFrame) -> Quadratic:
    """Fit on rows ``label, x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, DIM)
            y = batch.column("label").to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] = total.get(k, 0) + np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["label", "sums"])

    parts = in_arrow(train, run, "label int, sums array<double>").select("label", F.posexplode("sums"))
    rows = parts.groupBy("label", "pos").agg(F.sum("col").alias("v")).collect()
    sums: dict[int, np.ndarray] = {}
    for r in rows:
        sums.setdefault(r.label, np.zeros(1 + DIM + DIM * DIM))[r.pos] = r.v
    return from_sums(sums)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; ``labels`` has ``doc_id, label``."""
    featured = settle(featurise(docs))
    model = fit(featured.join(training_rows(labels), "doc_id").select("label", "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(batch.column("x").flatten().to_numpy().reshape(-1, DIM))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    scored = in_arrow(featured, run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score under ``threshold``; only training rows and then each row once go to Python."""
    chosen = training_rows(labels)
    model = fit(featurise(docs.join(chosen, "doc_id", "left_semi")).join(chosen, "doc_id").select("label", "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(model.score(features(part.column("text"))) >= threshold))

    return in_arrow(docs, run, docs.schema)
