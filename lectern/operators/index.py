"""The hybrid index: segments of points, vectors and postings under one manifest, and search over them.

An index is a folder with ``manifest.json`` and Parquet tables.  What the
manifest names is the index: a build or an update writes a new segment of each
table first and then puts a new manifest in the old one's place by a rename, so a
reader sees one version or the other, and a run that fails changes nothing.

====================  =========================================================
``points``            a row for each chunk: id, stored fields, words, length, range and place
``vectors``           packed unit vectors by cell (``vectors``), in folders by cell
``centroids``         the cells' centres
``postings``          for each term and range the chunks' places in it, counts, and what bounds the weights, in folders by slot of the term, sorted by term and range
``terms``             changes of the terms' document frequencies
``removed``           chunks of earlier segments that later ones replaced or took away
====================  =========================================================

A range is ``RANGE`` chunks that were written side by side, or fewer at the end of
a task; a chunk has a place in its range, from 0, which postings name instead of
ids and lengths.  A term may have two rows of a range that a scan cut, which only
loosens its bounds.  A search reads the bounds of its terms first.  The best
posting of each row is a score that some chunk of its range reaches, and the bounds of all terms together are one that none exceeds; ranges
that cannot reach the best ``candidates`` scores so far are left out before
postings are read.  Their chunks may still turn up through other ranges' terms?
No: a chunk is in one range, so it is read with all its terms or not at all, and
ranks and scores are those of a search over everything.

One writer at a time.  Empty chunks make an empty index, which finds nothing.
Null titles and paths count as empty; chunks need distinct, non-null ids, which
``validate`` checks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import analysis
from lectern.functions import text as T
from lectern.operators import layout, retrieval
from lectern.operators import vectors as V
from lectern.sources import files
from lectern.sources.sinks import release, stage, tidy

DIMENSION = 64
#: Chunks of a range; terms and ranges of one search that go into the scan as literals.
RANGE, LITERALS = 256, 2000
#: Pairs of queries and terms of one search that go to all tasks, and queries whose hits do.
PAIRS, SENT = 1 << 19, 2048
#: Times the wanted neighbours that are looked at first where some may have been removed.
AHEAD = 4
#: Ranges whose places of removed chunks go to all tasks, a kB of each.
SPREAD = 1 << 14
#: Chunks for each slot of terms at least.
SLOT = 1000
#: Documents that the manifest lists; of more it gives the number, and ``points`` has them.
LISTED = 10_000
MANIFEST = "manifest.json"
#: Columns of the tables in folders of their own, which may be empty.
COLUMNS = {
    "postings": "term string, range long, places array<int>, tfs array<int>, least_length int, best_tf int, best_length int, most_tf int, n int, segment int, slot int",
    "terms": "term string, change long, segment int, slot int",
    "vectors": "keys array<string>, tags array<string>, matrix binary, segment int, cell int",
}

#: What bounds the weights of a term in a range.
BOUNDS = ("most_tf", "least_length", "best_tf", "best_length")
#: Rows of a task are numbered below this.
TASK = 1 << 33

#: Turns rows ``key, text`` into ``key, embedding`` (unit vectors).
Encoder = Callable[[DataFrame, str, str], DataFrame]


class StoreError(ValueError):
    """An index that is not there, is there already, or does not fit what is put into it."""


def hashed_terms(texts: DataFrame, key: str, text: str, dimension: int = DIMENSION) -> DataFrame:
    """An encoder without a model: signed feature hashing of terms, square-root counts, unit length.

    A text without terms gets the zero vector, which is similar to nothing.
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _slices(batch):
                if not own.num_rows:
                    continue
                row, code, n, words = _tallied(own.column("w"))
                digests = [hashlib.md5(w.encode()).hexdigest() for w in words]
                place = np.array([int(h[:4], 16) % dimension for h in digests], np.int64)
                sign = np.array([1.0 if h[4] < "8" else -1.0 for h in digests])
                dense = np.bincount(row * dimension + place[code], sign[code] * np.sqrt(n), own.num_rows * dimension).astype(np.float64).reshape(-1, dimension)
                length = np.linalg.norm(dense, axis=1, keepdims=True)
                dense /= np.where(length > 0, length, 1.0)
                lists = pa.ListArray.from_arrays(np.arange(own.num_rows + 1, dtype=np.int32) * dimension, dense.ravel())
                yield pa.RecordBatch.from_arrays([own.column(key), lists], [key, "embedding"])

    words = texts.select(key, F.coalesce(retrieval.terms(F.col(text)), F.array().cast("array<string>")).alias("w"))
    return words.mapInArrow(run, f"{key} {kind}, embedding array<double>")


#: Texts whose words are counted at once.
COUNTED = 2048


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, COUNTED):
        yield batch.slice(a, COUNTED)


def _tallied(lists: pa.ListArray, renamed: Callable[[str], str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """For lists of words: row, number of the word and how often the row has it, by row, and the words by number; ``renamed`` sees each distinct word once."""
    flat = lists.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if renamed is not None:
        number: dict[str, int] = {}
        code = np.array([number.setdefault(renamed(w), len(number)) for w in words], np.int64)[code]
        words = list(number)
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), size)
    pair, n = np.unique(row * max(len(words), 1) + code, return_counts=True)
    return pair // max(len(words), 1), pair % max(len(words), 1), n, words


def from_table(vectors: DataFrame, column: str = "embedding") -> Encoder:
    """An encoder that looks vectors up in ``key, embedding``; texts without one are left out."""

    def encode(texts: DataFrame, key: str, text: str) -> DataFrame:
        return texts.select(key).join(vectors.select(key, F.col(column).alias("embedding")), key)

    return encode


def carries(encode: Encoder) -> Encoder:
    """Mark an encoder that hands keys of any type on with their rows, so that a chunk's key may bring its document."""
    encode.carries = True
    return encode


carries(hashed_terms)


def _name(encode: Encoder) -> str:
    """A model's name, for whose entry points it is the encoder, or a function's."""
    return getattr(getattr(encode, "__self__", None), "name", None) or encode.__name__.replace("_", "-")


def lexical(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "document_id", retrieval.lexical_text(F.col("title"), F.col("heading_path"), F.col("text")).alias("text"))


def points(chunks: DataFrame, *more: Column) -> DataFrame:
    """``id, chunk_id, document_id``, the stored fields of each chunk and its number of ``words``; ``more`` columns besides."""
    text = retrieval.lexical_text(F.col("title"), F.col("heading_path"), F.col("text"))
    stored = [c for c in retrieval.PAYLOAD if c in chunks.columns]
    return chunks.select(T.point_id(F.col("chunk_id")).alias("id"), *stored, F.greatest(F.lit(1), F.size(retrieval.terms(text))).cast("long").alias("words"), *more)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``range`` and ``place``, by how they lie: nothing is dealt for it.  To be written once, then read."""
    row = F.col("_n") % TASK
    return rows.withColumn("_n", F.monotonically_increasing_id()).withColumns({"range": F.col("_n") - row + F.floor(row / RANGE), "place": (row % RANGE).cast("int")}).drop("_n")


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(slots)).cast("int")


def _words(chunks: DataFrame, language: str | None) -> DataFrame:
    """Chunks with their words ``w`` as they stand, of which ``language`` may drop some; each becomes one term."""
    text = retrieval.lexical_text(F.col("title"), F.col("heading_path"), F.col("text"))
    return chunks.withColumn("w", analysis.words(text, language))


#: Words whose stems a task remembers.
STEMMED = 1 << 17


def _stemmed(language: str | None) -> Callable[[str], str] | None:
    """What stems a word and remembers it, in bounded memory; None where words stay as they are."""
    stem = analysis.stemmer(language)
    return stem and lru_cache(STEMMED)(stem)


def _held(rows: DataFrame, language: str | None) -> DataFrame:
    """``term, n``: of rows ``w``, how many have each term, summed over as many as lie side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem = _stemmed(language)
        for batch in batches:
            for own in _slices(batch):
                _, code, _, words = _tallied(own.column("w"), stem)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.bincount(code, minlength=len(words)).astype(np.int64))], ["term", "n"])

    return rows.select("w").filter("size(w) > 0").mapInArrow(run, "term string, n long")


def _packed(rows: DataFrame, average: float, language: str | None = None) -> DataFrame:
    """``term, range, places, tfs`` and what bounds the weights, of rows ``range, place, w``, packed from as many as lie side by side; words become terms here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem = _stemmed(language)
        for batch in batches:
            for own in _slices(batch):
                row, code, n, words = _tallied(own.column("w"), stem)
                if not len(row):
                    continue
                ranges, places = (own.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("range", "place"))
                long = own.column("w").value_lengths().to_numpy(zero_copy_only=False)
                order = np.lexsort((places[row], ranges[row], code))
                row, code, n = row[order], code[order], n[order]
                first = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(ranges[row]) != 0)])
                ends, length = np.r_[first, len(row)].astype(np.int32), long[row]
                weight = n * (retrieval.K1 + 1) / (n + retrieval.K1 * (1 - retrieval.B + retrieval.B * length / average))
                best = np.lexsort((weight, np.repeat(np.arange(len(first)), np.diff(ends))))[ends[1:] - 1]
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (places[row], n)]
                values = (x.astype(np.int32) for x in (np.minimum.reduceat(length, first), n[best], length[best]))
                terms = pa.array(words).take(pa.array(code[first]))
                yield pa.RecordBatch.from_arrays([terms, pa.array(ranges[row][first]), *lists, *map(pa.array, values)], ["term", "range", "places", "tfs", "least_length", "best_tf", "best_length"])

    kinds = dict(field.split(" ") for field in COLUMNS["postings"].split(", "))
    return rows.filter("size(w) > 0").mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items() if c not in ("segment", "slot", "most_tf", "n")))


def _best_of_ranges(rows: DataFrame, weighed: list, average: float, limit: int) -> DataFrame:
    """``query_id, chunk_id, score``: of each task, the best ``limit`` of each query over its ranges ``_terms, _members``.

    ``weighed`` are rows ``query_id, term, idf``.  A range is a matrix of its
    terms and chunks, so no row is made for a query and a chunk that cannot stay.
    """
    queries, words = np.array(sorted({r.query_id for r in weighed}), np.int64), sorted({r.term for r in weighed})
    number = {w: k for k, w in enumerate(words)}
    at = np.array([number[r.term] for r in weighed], np.int64), np.searchsorted(queries, [r.query_id for r in weighed]), np.array([r.idf for r in weighed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, order = V._Best(limit, "chunk_id", pa.string()), np.argsort(at[1], kind="stable")
        term, query, idf = (x[order] for x in at)
        for batch in batches:
            for i in range(batch.num_rows):
                own, members = (batch.column(c)[i].values for c in ("_terms", "_members"))
                size = own.field("places").value_lengths().to_numpy()
                place, tf = (own.field(c).flatten().to_numpy().astype(np.int64) for c in ("places", "tfs"))
                long, live = (members.field(c).to_numpy(zero_copy_only=False) for c in ("length", "_live"))
                keys = np.array(members.field("chunk_id").to_pylist(), object)
                # a term whose postings a scan cut has its places in two rows
                there, line = np.unique([number[w] for w in own.field("term").to_pylist()], return_inverse=True)
                weight = np.zeros((len(there), len(keys)))
                weight[np.repeat(line, size), place] = retrieval.weight(average, tf, long[place])
                weight[:, ~live.astype(bool)] = 0.0
                at_line = np.full(len(words), -1)
                at_line[there] = np.arange(len(there))
                for a in range(0, len(queries), V.QUERY_BLOCK):
                    mine = slice(*np.searchsorted(query, [a, a + V.QUERY_BLOCK]))
                    met = at_line[term[mine]] >= 0
                    used, column = np.unique(at_line[term[mine][met]], return_inverse=True)
                    table = np.zeros((min(V.QUERY_BLOCK, len(queries) - a), len(used)))
                    table[query[mine][met] - a, column] = idf[mine][met]
                    score = table @ weight[used]
                    # whatever could be among the best by rounded scores, and ties of the last of them
                    least = np.partition(score, max(len(keys) - limit, 0), axis=1)[:, max(len(keys) - limit, 0)] - 10.0**-retrieval.RANK_PLACES
                    q, k = np.nonzero((score > 0) & (score >= least[:, None]))
                    best.add(queries[a + q], score[q, k], keys[k])
                    if best.n > V.HELD // 2:
                        yield from best.out()
        yield from best.out()

    return rows.select("_terms", "_members").mapInArrow(run, "query_id long, chunk_id string, score double")


def build(
    chunks: DataFrame,
    path: str,
    encode: Encoder = hashed_terms,
    recreate: bool = False,
    language: str | None = None,
    slots: int | None = None,
    cells: int | None = None,
    facts: dict | None = None,
) -> None:
    """Write the index of the chunks to ``path``; an existing one is an error unless it is recreated.

    ``language`` chooses stop words and stems; ``slots`` (by default the number of
    shuffle partitions, of few chunks fewer) and ``cells`` how finely terms and vectors are clustered;
    ``facts`` go into the manifest.
    """
    spark = chunks.sparkSession
    old = _manifest(spark, path) if files.exists(spark, f"{path}/{MANIFEST}") else None
    if old and not recreate:
        raise StoreError(f"an index exists at {path}")
    manifest = {"version": 0, "segments": [], "chunk_count": 0, "word_total": 0, "language": language, "slots": slots, "cells": cells, "dimension": None, "encoder": _name(encode), "facts": facts or {}}
    manifest["next_segment"] = old["next_segment"] if old else 1
    manifest["version"] = old["version"] if old else 0
    with tidy(spark):
        manifest = _with_segment(chunks, path, manifest, encode)
    _publish(spark, path, manifest)


def update(chunks: DataFrame, path: str, encode: Encoder = hashed_terms, removed: DataFrame | None = None) -> dict:
    """Bring chunks into the index at ``path`` and take those named in ``removed`` (``chunk_id``) out; the new manifest.

    A chunk whose id and ``content_hash`` are there already stays as it is.  One
    whose id is there with other content replaces it.  Ids that are not there are
    passed over in ``removed``; an id in both is replaced.  Costs grow with the
    changes and one scan of the ids.
    """
    spark = chunks.sparkSession
    own = Index(spark, path)
    live = own.points.select("chunk_id", "segment", F.col("content_hash").alias("old_hash"))
    known = live.select("chunk_id", F.col("old_hash").alias("content_hash"))
    fresh = stage(chunks.join(known, ["chunk_id", "content_hash"], "left_anti"))
    gone = fresh.select("chunk_id")
    if removed is not None:
        gone = gone.union(removed.select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti"))
    # where they lie, not what they say: their texts are read there
    lost = stage(own.points.select("chunk_id", "segment", "range", "place", "words").join(gone, "chunk_id", "left_semi"))
    with tidy(spark):
        manifest = _with_segment(fresh, path, own.manifest, encode, lost, texts=own.at(lost))
    for done in (fresh, lost):
        release(done)
    return _publish(spark, path, manifest)


def compact(path: str, spark: SparkSession) -> dict:
    """Fold all segments into one; searches find what they found."""
    own = Index(spark, path)
    empty = {"segments": [], "chunk_count": 0, "word_total": 0}
    # the vectors are there with their documents: they are read, not encoded and joined
    none = spark.createDataFrame([], "key string, tag string, embedding array<double>")
    vectors = none if own._table("vectors") is None else own.embeddings.select(F.col("chunk_id").alias("key"), F.col("document_id").alias("tag"), "embedding")
    with tidy(spark):
        manifest = _with_segment(own.points, path, own.manifest | empty | {"centroids": None}, hashed_terms, keyed=vectors)
    return _publish(spark, path, manifest)


def vacuum(path: str, spark: SparkSession) -> list[str]:
    """Remove the segments that the manifest no longer names, and name them; readers of older versions lose their files."""
    kept = {f"segment={k}" for k in _manifest(spark, path)["segments"]}
    stale = [f"{path}/{t}/{s}" for t in files.names(spark, path) if t != MANIFEST for s in files.names(spark, f"{path}/{t}") if s.startswith("segment=") and s not in kept]
    for folder in stale:
        files.remove(spark, folder)
    return stale


def _with_segment(chunks: DataFrame, path: str, manifest: dict, encode: Encoder, gone: DataFrame | None = None, keyed: DataFrame | None = None, texts: DataFrame | None = None) -> dict:
    """Write a segment of ``chunks`` that replaces the points ``gone``, whose stored fields are ``texts``; the manifest with it.  ``keyed`` are the chunks' vectors, where they are known."""
    spark, k = chunks.sparkSession, manifest["next_segment"]
    at = lambda table: f"{path}/{table}/segment={k}"
    language = manifest["language"]
    # ranges are chunks as they lie, so their texts are not dealt by range
    lexical_ = retrieval.lexical_text(F.col("title"), F.col("heading_path"), F.col("text"))
    made = points(chunks, F.size(analysis.words(lexical_, language)).alias("length"))
    _numbered(made).write.mode("overwrite").option("compression", "zstd").parquet(at("points"))
    written = spark.read.parquet(at("points"))
    sums = (F.count("*").alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    added, taken = written.agg(*sums).first(), gone.agg(*sums).first() if gone is not None else None
    n, total = (manifest[c] + a - (t or 0) for c, a, t in (("chunk_count", added.n, taken and taken.n), ("word_total", added.words, taken and taken.words)))
    average = total / n if n else retrieval.EMPTY_LENGTH
    slots = manifest["slots"] or min(int(spark.conf.get("spark.sql.shuffle.partitions")), added.n // SLOT + 1)
    manifest = manifest | {"slots": slots}

    # packed where the words are: a term is dealt once for each range; what follows from the lists is made behind that
    packed = _packed(_words(written, language).select("range", "place", "w"), average, language).withColumn("slot", _slot(slots))
    whole = packed.repartitionById(slots, "slot").withColumns({"most_tf": F.array_max("tfs"), "n": F.size("places")})
    whole.sortWithinPartitions("slot", "term", "range").write.mode("overwrite").option("compression", "zstd").partitionBy("slot").parquet(at("postings"))
    changes = _read(spark, "postings", [at("postings")]).groupBy("slot", "term").agg(F.sum("n").alias("change"))
    if gone is not None:
        lost = _held(_words(texts, language), language).groupBy("term").agg((-F.sum("n")).alias("change"))
        changes = changes.unionByName(lost.withColumn("slot", _slot(slots)))
        gone.select("chunk_id", F.col("segment").alias("of"), "range").write.mode("overwrite").parquet(at("removed"))
    changes.repartitionByRange("slot", "term").sortWithinPartitions("slot", "term").write.mode("overwrite").partitionBy("slot").parquet(at("terms"))

    encoded_here = keyed is None
    if encoded_here:
        text = retrieval.dense_text(F.col("embedding_text") if "embedding_text" in chunks.columns else F.lit(""), F.col("title"), F.col("heading_path"), F.col("text"))
        if getattr(encode, "carries", False):
            encoded = encode(chunks.select(F.struct("chunk_id", "document_id").alias("key"), text.alias("text")), "key", "text").select("key.chunk_id", "key.document_id", "embedding")
        else:
            encoded = encode(chunks.select("chunk_id", text.alias("text")), "chunk_id", "text").join(written.select("chunk_id", "document_id"), "chunk_id")
        # read for the dimension, the sample, the cells' ranges and the cells: encoded once
        keyed = stage(encoded.filter("embedding IS NOT NULL").select(F.col("chunk_id").alias("key"), F.col("document_id").alias("tag"), "embedding"))
    first = keyed.select(F.size("embedding").alias("d")).first()
    dimension = manifest["dimension"] or (first.d if first else None)
    if first:
        if dimension != first.d:
            raise StoreError(f"vectors have {first.d} places, those of the index {dimension}")
        if not manifest.get("centroids"):
            centre, probes = V.centroids(keyed, added.n, dimension, manifest["cells"], retrieval.CANDIDATES)
            spark.createDataFrame(list(enumerate(centre.tolist())), "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(at("centroids"))
            manifest = manifest | {"centroids": k, "cells": len(centre), "probes": probes}
        celled = V.with_cells(keyed, _centroids(spark, path, manifest)).repartitionByRange("cell", "key").sortWithinPartitions("cell")
        V.pack(celled).write.mode("overwrite").partitionBy("cell").parquet(at("vectors"))
    if encoded_here:
        release(keyed)
    return manifest | {"segments": [*manifest["segments"], k], "next_segment": k + 1, "version": manifest["version"] + 1, "chunk_count": n, "word_total": int(total), "dimension": dimension}


def _publish(spark: SparkSession, path: str, manifest: dict) -> dict:
    """Put the manifest in its place, with the facts that a reader wants to know."""
    own = Index(spark, path, manifest)
    ids = own.documents
    count = ids.count()
    now = spark.range(1).select(layout.utc_now().alias("t")).first().t
    told = {
        "schema_version": "1.0", "created_at": now, "collection_name": path.rstrip("/").rpartition("/")[2], "dense_model": manifest["encoder"], "dense_dimension": manifest["dimension"], "sparse_model": "bm25",
        "bm25_language": manifest["language"], "bm25_average_document_length": round(own.average, 4), "distance": "cosine", "fusion": "rrf", "dense_vector_name": "dense", "sparse_vector_name": "bm25",
        "document_ids": [r.document_id for r in ids.orderBy("document_id").collect()] if count <= LISTED else None, "document_count": count, "store_mode": "local", "store_path": path, "store_url": None,
    }
    files.write_text(spark, f"{path}/{MANIFEST}", json.dumps(told | manifest["facts"] | {"state": manifest}, indent=2, default=str))
    return manifest


def _manifest(spark: SparkSession, path: str) -> dict:
    if not files.exists(spark, f"{path}/{MANIFEST}"):
        raise StoreError(f"there is no index at {path}")
    return json.loads(files.read_text(spark, f"{path}/{MANIFEST}"))["state"]


def described(spark: SparkSession, path: str) -> dict:
    """The manifest for readers: models, names, language, average length, documents, counts, place."""
    told = json.loads(files.read_text(spark, f"{path}/{MANIFEST}"))
    return {k: v for k, v in told.items() if k != "state"} | {"chunk_count": told["state"]["chunk_count"]}


def _read(spark: SparkSession, name: str, paths: list[str]) -> DataFrame:
    reader = spark.read.option("basePath", paths[0].rpartition("/")[0])
    return (reader.schema(COLUMNS[name]) if name in COLUMNS else reader).parquet(*paths)


def _centroids(spark: SparkSession, path: str, manifest: dict) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids/segment={manifest['centroids']}").orderBy("cell").collect()
    return np.array([r.centre for r in rows])


class Index:
    """An index that was written to a folder, as it was when this was made."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict | None = None):
        self.spark, self.path = spark, path
        self.manifest = manifest or _manifest(spark, path)
        self.language, self.n = self.manifest["language"], self.manifest["chunk_count"]
        self.average = self.manifest["word_total"] / self.n if self.n else retrieval.EMPTY_LENGTH

    def _table(self, name: str) -> DataFrame | None:
        """All segments of a table; None where none has it."""
        there = files.names(self.spark, f"{self.path}/{name}")
        own = [f"{self.path}/{name}/segment={k}" for k in self.manifest["segments"] if f"segment={k}" in there]
        return _read(self.spark, name, own) if own else None

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows ``segment, chunk_id`` without what later segments replaced."""
        removed = self._table("removed")
        if removed is None:
            return rows
        return rows.join(removed.select(F.col("of").alias("segment"), "chunk_id"), ["segment", "chunk_id"], "left_anti")

    @property
    def points(self) -> DataFrame:
        return self._live(self._table("points"))

    def at(self, places: DataFrame) -> DataFrame:
        """The points at ``segment, range, place``; of few ranges they are picked where they lie, and no text is dealt."""
        by = places.groupBy("segment", "range").agg(F.collect_set("place").alias("_places"))
        by = F.broadcast(by) if V.few(by, SPREAD) else by
        return self._table("points").join(by, ["segment", "range"]).filter(F.array_contains("_places", F.col("place"))).drop("_places")

    @property
    def documents(self) -> DataFrame:
        """``document_id`` of all documents with chunks, also where the manifest gives their number only."""
        return self.points.select("document_id").distinct()

    @property
    def postings(self) -> DataFrame:
        """``chunk_id, document_id, term, tf, length, df`` of all chunks."""
        return self._unpacked(self._table("postings").select("segment", "range", "term", "places", "tfs").join(self._terms(), "term"))

    def _unpacked(self, packed: DataFrame) -> DataFrame:
        """A row for each chunk that is left of packed postings; they meet the names of their range's chunks before they are unfolded."""
        each = F.arrays_zip("places", "tfs")
        rows = self._met(self._spread(packed), "document_id").withColumn("_e", F.explode(each)).withColumn("_m", F.get("_members", F.col("_e.places")))
        keep = [c for c in packed.columns if c not in ("places", "tfs", "n", *BOUNDS)]
        return rows.filter("_m._live").select(*keep, "_m.chunk_id", "_m.document_id", F.col("_e.tfs").cast("long").alias("tf"), "_m.length")

    def _spread(self, packed: DataFrame) -> DataFrame:
        """Rows dealt by range: they are small and unfold into many, and Spark would put them into few tasks by their size."""
        return packed.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "segment", "range")

    def _met(self, spread: DataFrame, *fields: str, document: Column | None = None) -> DataFrame:
        """Rows that lie by range with ``_members``, their range's chunks by place; ``_live`` are those that are left and fulfil the condition."""
        named = self._table("points").select("segment", "range", "place", "chunk_id", "length", *fields, (F.lit(True) if document is None else F.coalesce(document, F.lit(False))).alias("_live"))
        removed = self._table("removed")
        if removed is not None:
            gone = removed.select(F.col("of").alias("segment"), "chunk_id", F.lit(True).alias("_gone"))
            named = named.join(gone, ["segment", "chunk_id"], "left").withColumn("_live", F.col("_live") & F.col("_gone").isNull())
        members = named.groupBy("segment", "range").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id", "length", *fields, "_live"))).alias("_members"))
        # sending the rows to all tasks would put what they unfold into as few as there are of ranges' names
        return spread.join(members.hint("merge"), ["segment", "range"])

    @property
    def statistics(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(self.n).cast("long").alias("n"), F.lit(float(self.average)).alias("avg_length"))

    @property
    def embeddings(self) -> DataFrame:
        """``segment, cell, chunk_id, document_id, embedding``."""
        rows = V.unpack(self._table("vectors")).withColumnsRenamed({"key": "chunk_id", "tag": "document_id"})
        return self._live(rows)

    def _terms(self, among: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """``term, df`` of the terms that some chunk has."""
        return among(self._table("terms")).groupBy("term").agg(F.sum("change").alias("df")).filter("df > 0")

    def near(self, vectors: DataFrame, limit: int = retrieval.CANDIDATES, document: Column | None = None, probes: int | None = None) -> DataFrame:
        """``query_id, chunk_id, score, rank`` of the nearest chunks of ``query_id, embedding``.

        Exact unless ``probes`` cells are to do; ``manifest["probes"]`` suggests how many.
        """
        blocks = self._table("vectors")
        if blocks is None:
            return retrieval.ranked(self.spark.createDataFrame([], "query_id long, chunk_id string, score double"), "chunk_id", limit)
        cells = self.manifest["cells"]
        every = probes is None or probes >= cells
        small = V.few(vectors, V.SENT_ONCE if every else V.SENT)
        if every:
            asked = V.everywhere(vectors, None if small else cells)
        else:
            asked = V.aimed(vectors, _centroids(self.spark, self.path, self.manifest), probes)
            if small:
                # the cells go into the scan, which then opens their folders only
                blocks = blocks.filter(F.col("cell").isin([r.cell for r in asked.select("cell").distinct().collect()]))
        removed = self._table("removed")
        if document is None and removed is not None:
            found = self._near_live(blocks, asked, limit, small)
            if found is not None:
                return found
        if document is not None or removed is not None:
            rows = self._live(V.unpack(blocks).withColumnsRenamed({"key": "chunk_id", "tag": "document_id"}))
            rows = rows if document is None else rows.filter(document)
            blocks = V.pack(rows.withColumnsRenamed({"chunk_id": "key", "document_id": "tag"}))
        return retrieval.ranked(V.nearest(blocks, asked, limit, "chunk_id", small), "chunk_id", limit)

    def _near_live(self, blocks: DataFrame, asked: DataFrame, limit: int, few: bool) -> DataFrame | None:
        """The nearest that are left among ``AHEAD`` times as many of all, so that no vector is dealt; None where some query needs more."""
        # an id may be in several segments, so the segment stands behind it, where ties are in order of ids all the same
        named = blocks.withColumn("keys", F.transform("keys", lambda k: F.concat(k, F.lit("\0"), F.col("segment").cast("string"))))
        most = AHEAD * limit
        order = retrieval.W.partitionBy("query_id").orderBy(F.desc(F.round("score", retrieval.RANK_PLACES)), "chunk_id")
        found = V.nearest(named, asked, most, "chunk_id", few).withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most)
        segment = F.substring_index("chunk_id", "\0", -1)
        apart = found.select("query_id", "score", segment.cast("int").alias("segment"), F.left("chunk_id", F.length("chunk_id") - F.length(segment) - 1).alias("chunk_id"))
        found = stage(apart)
        live = stage(self._live(found))
        left = live.groupBy("query_id").agg(F.count("*").alias("left"))
        short = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") == most).join(left, "query_id", "left").filter(F.coalesce("left", F.lit(0)) < limit)
        return None if short.limit(1).count() else retrieval.ranked(live.select("query_id", "chunk_id", "score"), "chunk_id", limit)

    def spoken(self, queries: DataFrame, limit: int = retrieval.CANDIDATES, document: Column | None = None, pruned: bool = True) -> DataFrame:
        """``query_id, chunk_id, score, rank`` of the chunks that fit ``query_id, text`` best by BM25.

        ``pruned`` leaves ranges out that cannot reach the top; the rows are the
        same.  With a condition on documents nothing is left out beforehand.
        Each task hands on the best of each query only, unless queries and
        their terms are too many to be sent to it.
        """
        pruned = pruned and document is None
        asked = self._asked(queries)
        if asked is not None:
            among, few, weighed = asked
            pairs = weighed.limit(PAIRS + 1).collect()
            if len(pairs) <= PAIRS:
                rows = among(self._table("postings")).select("segment", "range", "term", "places", "tfs")
                if pruned and few:
                    # many terms together would need nearly every range
                    rows, kept = self._of_ranges(rows, self._promising(among, weighed, limit), few)
                    rows = self._spread(rows).join(kept.select("segment", "range").distinct().hint("merge"), ["segment", "range"], "left_semi")
                terms = self._spread(rows).groupBy("segment", "range").agg(F.collect_list(F.struct("term", "places", "tfs")).alias("_terms"))
                return retrieval.ranked(_best_of_ranges(self._met(terms, document=document), pairs, self.average, limit), "chunk_id", limit)
        hits = self.candidates(queries, limit, pruned)
        hits = hits if document is None else hits.filter(document)
        # a range's postings lie together already
        scored = hits.groupBy("segment", "range", "query_id", "chunk_id").agg(F.sum(F.col("idf") * retrieval.weight(F.lit(self.average))).alias("score"))
        return retrieval.ranked(scored, "chunk_id", limit)

    def _asked(self, queries: DataFrame) -> tuple[Callable[[DataFrame], DataFrame], bool, DataFrame] | None:
        """What keeps the rows of the queries' terms, whether these are few, and ``query_id, term, idf``; None where nothing can be found."""
        if self._table("postings") is None or not self.n:
            return None
        asked = queries.select("query_id", F.explode(F.array_distinct(retrieval.terms(F.col("text"), self.language))).alias("term")).withColumn("slot", _slot(self.manifest["slots"]))
        wanted = asked.select("term", "slot").distinct().limit(LITERALS + 1).collect()
        few = len(wanted) <= LITERALS
        literal = F.col("slot").isin(sorted({r.slot for r in wanted})) & F.col("term").isin(sorted({r.term for r in wanted}))
        among = lambda df: df.filter(literal) if few else df.join(asked.select("slot", "term").distinct(), ["slot", "term"], "left_semi")
        return among, few, asked.join(self._terms(among), "term").select("query_id", "term", retrieval.idf(F.lit(self.n), F.col("df")).alias("idf"))

    def _of_ranges(self, rows: DataFrame, kept: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
        """Rows of the scan that may be of the ranges ``kept``, where these are few, and ``kept``, written if terms are few."""
        if few:
            kept = stage(kept)
            ranges = kept.select("range").distinct().limit(LITERALS + 1).collect()
            if len(ranges) <= LITERALS:
                rows = rows.filter(F.col("range").isin(sorted(r.range for r in ranges)))
        return rows, kept

    def candidates(self, queries: DataFrame, limit: int = retrieval.CANDIDATES, pruned: bool = True) -> DataFrame:
        """Postings of the queries' terms (``query_id``, ``idf``), of the ranges that may hold one of the best ``limit``."""
        asked = self._asked(queries)
        if asked is None:
            return self.spark.createDataFrame([], "query_id long, segment int, range long, chunk_id string, document_id string, term string, tf long, length int, idf double")
        among, few, weighed = asked
        rows = among(self._table("postings")).select("segment", "range", "term", "places", "tfs")
        of_term = weighed.groupBy("term").agg(F.collect_list(F.struct("query_id", "idf")).alias("_asked"))
        if pruned:
            rows, kept = self._of_ranges(rows, self._promising(among, weighed, limit), few)
            # one row for each range, so postings are dealt by range once and not for each query
            wanted = kept.groupBy("segment", "range").agg(F.collect_set("query_id").alias("_wanted"))
            rows = self._spread(rows).join(wanted.hint("merge"), ["segment", "range"])
        rows = rows.join(F.broadcast(of_term) if few else of_term, "term")
        own = F.filter("_asked", lambda q: F.array_contains("_wanted", q["query_id"])) if pruned else F.col("_asked")
        found = self._unpacked(rows.withColumn("_asked", own).drop("_wanted").filter("size(_asked) > 0"))
        return found.withColumn("_q", F.explode("_asked")).select("_q.query_id", "segment", "range", "chunk_id", "document_id", "term", "tf", "length", "_q.idf")

    def _promising(self, among: Callable[[DataFrame], DataFrame], weighed: DataFrame, limit: int) -> DataFrame:
        """``query_id, segment, range`` of the ranges whose bound reaches the ``limit``-th best score that is sure to exist."""
        avg = F.lit(self.average)
        most = retrieval.weight(avg, F.col("most_tf"), F.col("least_length"))
        sure = retrieval.weight(avg, F.col("best_tf"), F.col("best_length"))
        bounds = among(self._table("postings")).select("segment", "range", "term", *BOUNDS).join(weighed, "term").groupBy("query_id", "segment", "range").agg(F.sum(F.col("idf") * most).alias("most"), F.max(F.col("idf") * sure).alias("sure"))
        removed = self._table("removed")
        if removed is not None:
            # the best posting of such a range may be gone
            touched = removed.select(F.col("of").alias("segment"), "range", F.lit(True).alias("touched")).distinct()
            bounds = bounds.join(touched, ["segment", "range"], "left").withColumn("sure", F.when(F.col("touched").isNull(), F.col("sure"))).drop("touched")
        order = F.row_number().over(retrieval.W.partitionBy("query_id").orderBy(F.desc_nulls_last("sure")))
        reached = bounds.withColumn("k", order).filter((F.col("k") == limit) & F.col("sure").isNotNull()).select("query_id", F.col("sure").alias("reached"))
        # sums in another order may differ behind the places that ranks go by
        enough = F.col("reached").isNull() | (F.col("most") >= F.col("reached") - 10.0 ** -(retrieval.RANK_PLACES - 1))
        return bounds.join(reached, "query_id", "left").filter(enough).select("query_id", "segment", "range")

    def search(
        self,
        queries: DataFrame,
        encode: Encoder = hashed_terms,
        document: Column | None = None,
        candidates: int = retrieval.CANDIDATES,
        top: int = retrieval.TOP_K,
        per_parent: int = retrieval.PER_PARENT,
        probes: int | None = None,
    ) -> DataFrame:
        """The best chunks of each query ``query_id, text``: stored fields, ``score`` of the fusion, ``rank`` and ``position``.

        ``document`` is a condition on ``document_id`` that both branches apply
        before they rank; statistics stay those of the whole index.  A query
        without terms has dense candidates only.
        """
        if top < 1 or candidates < top or per_parent < 1:
            raise ValueError(f"limits do not fit together: {top} results of {candidates} candidates, {per_parent} of a parent")
        near = self.near(encode(queries, "query_id", "text"), candidates, document, probes)
        fused = retrieval.fuse([near, self.spoken(queries, candidates, document)], "chunk_id", candidates)
        # hits of few queries go to the points, whose texts stay where they are
        fused = F.broadcast(fused) if V.few(queries, SENT) else fused
        # what was removed is left out of the hits: points are not dealt for it
        hits = self._live(fused.join(self._table("points"), "chunk_id"))
        return retrieval.diversify(hits.drop("segment", "range", "place", "words", "length"), most=per_parent, top=top)

    def answer(self, queries: DataFrame, parents: DataFrame | Callable[[DataFrame], DataFrame], mode: str = "auto", window: int = retrieval.WINDOW, parent_limit: int = retrieval.PARENT_LIMIT, budget: int = retrieval.CONTEXT_BUDGET, **options) -> tuple[DataFrame, DataFrame]:
        """Hits as ``search`` gives them, and the passages around them within the token budget; ``parents`` may be made from the hits."""
        if window < 0 or budget < 1:
            raise ValueError(f"window {window} or budget {budget} is too small")
        # written: read here and twice for the passages
        hits = stage(self.search(queries, **options))
        parents = parents(hits) if callable(parents) else parents
        passages = retrieval.contexts(hits, parents, self.points, mode, window, parent_limit, V.few(queries, SENT))
        return hits, retrieval.within_budget(passages, budget)
