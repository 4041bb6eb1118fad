"""Nearest vectors by blocks: packed matrices, cells around centroids, a top list kept by each task.

Rows ``cell, key, tag, embedding`` are packed into blocks of one cell: ids and a
matrix in one row.  Queries are packed alike, once for each cell they look at,
so a search is an equi-join of blocks on their cell and a matrix product for
each pair.  A task keeps the best of each query over all its blocks and hands
on only those.  A cell of many vectors is many blocks, which joins and scans
split like any rows.

Vectors are as they come: unit vectors give cosines.  A query or vector without
an embedding has no hits.  Hits of equal scores (in ``RANK_PLACES`` places) go by
key, so repeated vectors with different keys all count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Rows of a block of vectors and of queries; queries whose blocks may be sent to all tasks, for each of their cells and once for all cells.
BLOCK, QUERY_BLOCK, SENT, SENT_ONCE = 1024, 256, 2048, 16384
#: Found rows that a task holds before it drops what cannot stay.
HELD = 200_000
#: Bytes of the sample that centroids are fitted on, at most; rows for each centroid; rounds.
SAMPLE_BYTES, SAMPLE_ROWS, ROUNDS, MOST_CELLS = 32 << 20, 100, 12, 1024
#: Share of the nearest that the suggested number of cells is to find, and searches of the sample that tell it.
SHARE, ASKED = 0.95, 200
#: Scores are compared in so many places.
RANK_PLACES = 9


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def pack(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """``cell, keys, tags, matrix``: blocks of at most ``size`` rows ``cell, key, tag, embedding`` of one cell, made where the rows are."""
    key, tag = (rows.schema[c].dataType.simpleString() for c in ("key", "tag"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(batch.column("cell").to_numpy(), kind="stable")
            cell = batch.column("cell").to_numpy()[order]
            cuts = sorted({0, len(cell), *(np.flatnonzero(np.diff(cell)) + 1).tolist()})
            for a, b in zip(cuts, cuts[1:]):
                for c in range(a, b, size):
                    own = batch.take(pa.array(order[c : min(c + size, b)]))
                    lists = [pa.array([own.column(k).to_pylist()], pa.list_(own.column(k).type)) for k in ("key", "tag")]
                    yield pa.RecordBatch.from_arrays([pa.array([int(cell[a])], pa.int32()), *lists, pa.array([_matrix(own.column("embedding")).tobytes()])], ["cell", "keys", "tags", "matrix"])

    known = rows.filter("embedding IS NOT NULL AND key IS NOT NULL").select(F.col("cell").cast("int").alias("cell"), "key", "tag", "embedding")
    return known.mapInArrow(run, f"cell int, keys array<{key}>, tags array<{tag}>, matrix binary")


def unpack(blocks: DataFrame) -> DataFrame:
    """The rows of blocks; columns besides those of blocks stay."""
    more = [c for c in blocks.columns if c not in ("cell", "keys", "tags", "matrix")]
    key, tag = (blocks.schema[c].dataType.elementType.simpleString() for c in ("keys", "tags"))
    kinds = [(c, blocks.schema[c].dataType.simpleString()) for c in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, tags = (batch.column(c)[i].values for c in ("keys", "tags"))
                matrix = np.frombuffer(batch.column("matrix")[i].as_py()).reshape(len(keys), -1)
                flat = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * matrix.shape[1], matrix.ravel())
                same = [pa.array([batch.column(c)[i].as_py()] * len(keys), batch.column(c).type) for c in ("cell", *more)]
                yield pa.RecordBatch.from_arrays([*same, keys, tags, flat], ["cell", *more, "key", "tag", "embedding"])

    schema = ", ".join(f"{c} {k}" for c, k in [("cell", "int"), *kinds, ("key", key), ("tag", tag), ("embedding", "array<double>")])
    return blocks.select("cell", *more, "keys", "tags", "matrix").mapInArrow(run, schema)


def centroids(rows: DataFrame, n: int, dimension: int, cells: int | None = None, limit: int = 30) -> tuple[np.ndarray, int]:
    """Unit vectors of ``cells`` centres (by default half the square root of ``n``), fitted on a sample, and how many cells a search should look at.

    The sample are the rows ``key, embedding`` with the least hashes: about
    ``SAMPLE_ROWS`` for each centre and at most ``SAMPLE_BYTES``; it decides how
    fast a search is and how much it finds, not which vectors are there.  With
    the number of cells that comes with the centres, searches within the sample
    find ``SHARE`` of their nearest, as many as are to ``limit`` what the sample
    is to all rows.
    """
    cells = cells or max(1, min(MOST_CELLS, round(n**0.5 / 2)))
    wanted = min(SAMPLE_ROWS * cells, SAMPLE_BYTES // (8 * max(dimension, 1)))
    share = min(1.0, wanted / max(n, 1))
    chosen = rows.filter("embedding IS NOT NULL").withColumn("h", F.xxhash64("key")).filter(F.col("h").bitwiseAND((1 << 40) - 1) <= int(share * ((1 << 40) - 1)))
    x = _matrix(chosen.orderBy("h", "key").select("embedding").toArrow().column(0).combine_chunks())
    if not len(x):
        return np.zeros((0, dimension)), 0
    rng = np.random.default_rng(7)
    centre = x[np.sort(rng.choice(len(x), min(cells, len(x)), replace=False))].copy()
    for _ in range(ROUNDS):
        own = np.argmax(x @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(length > 0, total / np.maximum(length, 1e-300), centre)
    own, asked = np.argmax(x @ centre.T, axis=1), x[rng.permutation(len(x))[:ASKED]]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, : max(1, round(limit * len(x) / max(n, 1)))]
    place = np.argsort(np.argsort(-(asked @ centre.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return centre, int(needed[min(int(SHARE * len(needed)), len(needed) - 1)]) + 1


def with_cells(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """Rows ``key, tag, embedding`` with the ``cell`` of the centre each is most like; the first of equals."""
    key, tag = (rows.schema[c].dataType.simpleString() for c in ("key", "tag"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = np.argmax(_matrix(batch.column("embedding")) @ centre.T, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], ["cell", "key", "tag", "embedding"])

    known = rows.filter("embedding IS NOT NULL").select("key", "tag", F.col("embedding").cast("array<double>").alias("embedding"))
    return known.mapInArrow(run, f"cell int, key {key}, tag {tag}, embedding array<double>")


def aimed(queries: DataFrame, centre: np.ndarray, probes: int | None = None) -> DataFrame:
    """Blocks ``cell, query_ids, queries`` of the queries ``query_id, embedding`` for each of the ``probes`` cells nearest to them, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, QUERY_BLOCK):
                own = batch.slice(a, QUERY_BLOCK)
                ids, x = own.column("query_id").to_numpy(), _matrix(own.column("embedding"))
                nearest = np.argsort(-(x @ centre.T), axis=1, kind="stable")[:, :probes]
                for cell in range(len(centre)):
                    at = np.flatnonzero((nearest == cell).any(axis=1))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([ids[at].tolist()], pa.list_(pa.int64())), pa.array([x[at].tobytes()])], ["cell", "query_ids", "queries"])

    known = queries.filter("embedding IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return known.mapInArrow(run, "cell int, query_ids array<long>, queries binary")


def everywhere(queries: DataFrame, cells: int | None) -> DataFrame:
    """As ``aimed``, for every one of ``cells`` cells; without a number once, without a cell, to be sent to all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, QUERY_BLOCK):
                own = batch.slice(a, QUERY_BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([own.column("query_id").to_pylist()], pa.list_(pa.int64())), pa.array([_matrix(own.column("embedding")).tobytes()])], ["query_ids", "queries"])

    known = queries.filter("embedding IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    made = known.mapInArrow(run, "query_ids array<long>, queries binary")
    return made if cells is None else made.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).select("cell", "query_ids", "queries")


class _Best:
    """The best ``limit`` keys of each query so far."""

    def __init__(self, limit: int, key: str, kind: pa.DataType):
        self.limit, self.key, self.kind = limit, key, kind
        self.query, self.score, self.keys, self.n = [], [], [], 0

    def add(self, query: np.ndarray, score: np.ndarray, keys: np.ndarray) -> None:
        self.query.append(query)
        self.score.append(score)
        self.keys.append(keys)
        self.n += len(query)
        if self.n > HELD:
            self.shrink()

    def shrink(self) -> None:
        query, score, keys = (np.concatenate(x) for x in (self.query, self.score, self.keys))
        _, place = np.unique(keys, return_inverse=True)
        order = np.lexsort((place, -np.round(score, RANK_PLACES), query))
        query, score, keys = query[order], score[order], keys[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < self.limit
        self.query, self.score, self.keys = [query[kept]], [score[kept]], [keys[kept]]
        self.n = int(kept.sum())

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            self.shrink()
            yield pa.RecordBatch.from_arrays([pa.array(self.query[0]), pa.array(self.keys[0].tolist(), self.kind), pa.array(self.score[0])], ["query_id", self.key, "score"])
            self.query, self.score, self.keys, self.n = [], [], [], 0


def nearest(blocks: DataFrame, asked: DataFrame, limit: int, key: str, few: bool) -> DataFrame:
    """``query_id, key, score``: of each task, the best ``limit`` of each query over its pairs of blocks.

    ``few`` says that the queries are few enough to go to all tasks; otherwise both
    sides meet by cell.  Queries without a cell meet all blocks.
    """
    element: DataType = blocks.schema["keys"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for i in range(batch.num_rows):
                ids, keys = (batch.column(c)[i].values for c in ("query_ids", "keys"))
                best = best or _Best(limit, key, keys.type)
                q, x = (np.frombuffer(batch.column(c)[i].as_py()).reshape(len(n), -1) for c, n in (("queries", ids), ("matrix", keys)))
                score = q @ x.T
                # whatever could be among the best by rounded scores, and ties of the last of them
                least = np.partition(score, max(len(keys) - limit, 0), axis=1)[:, max(len(keys) - limit, 0)] - 10.0**-RANK_PLACES
                a, b = np.nonzero(score >= least[:, None])
                best.add(ids.to_numpy()[a], score[a, b], np.array(keys.to_pylist(), object if pa.types.is_string(keys.type) else None)[b])
                if best.n > HELD // 2:
                    yield from best.out()
        if best is not None:
            yield from best.out()

    met = blocks.join(F.broadcast(asked) if few else asked, "cell") if "cell" in asked.columns else blocks.crossJoin(F.broadcast(asked))
    pairs = met.select("query_ids", "queries", "keys", "matrix")
    return pairs.mapInArrow(run, f"query_id long, {key} {element.simpleString()}, score double")


def few(queries: DataFrame, most: int | None = None) -> bool:
    """Whether there are at most ``most`` queries, by default ``SENT``; no more than that many and one are counted."""
    most = SENT if most is None else most
    return queries.limit(most + 1).count() <= most
