"""Spelling variants: words that differ by one code point, found by two-dimensional range reporting.

For each place of an edit, the words with the same letters before it are an
interval of the words in forward order, and those with the same letters behind
it an interval of the words in the order of their ends.  The words in both are
reported by a wavelet tree (``wavelet``), among words of one length: for a
replaced letter those as long as the word, for an inserted one those with one
letter more; a deletion is an insertion seen from the other word.

Two such words have the first half or the second half in common.  So each word
goes to the bucket of its first half, where edits behind it are looked up, and,
read backwards, to that of its second half.  A tree is built over many whole
buckets at a time.  A bucket of more than ``MOST`` words is split by the next
letter, as often as needed; edits of just that letter are then found by a join
on what stands before and behind it, which at most as many words share as there
are letters.

Each near pair is found once: a letter put into a run of its like counts as put
before the run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import sql
from lectern.llm.spark import discard, in_arrow, settle
from lectern.llm.wavelet import Grid, code_points

#: What a run of letters is, and the letters that are lower-cased.
RUN, CAPITALS, SMALL = "[A-Za-zÀ-ÿ]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a letter.
DAMAGED = 199
#: Words of a bucket, code points of the buckets that share a tree.
MOST, TREE = 50_000, 2_000_000
_BUCKET = ("back", "length", "shared")


def words(docs: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """``word, n``: the runs of letters of all texts, lower-cased (A-Z only), some without a letter, and their counts.

    A run loses the code point ``h % length`` where ``DAMAGED`` divides ``h``,
    the crc32 of ``<doc_id>:<run>``.  A null text has no runs; a null
    ``doc_id`` is written as nothing.  Repeated rows count each time.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")
    # lower() also changes letters outside A-Z, which are put through only where there are none
    low = F.when(F.col("run").rlike("[À-Þ]"), F.translate("run", CAPITALS, SMALL)).otherwise(F.lower("run"))
    lowered = docs.select("doc_id", run).select("doc_id", low.alias("run")).filter(F.length("run") >= least_length)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = F.col("h") % F.length("run")
    cut = F.concat(F.expr("left(run, cast(h % length(run) as int))"), F.substring("run", (at + 2).cast("int"), F.length("run")))
    word = F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run"))
    found = lowered.select("run", h.alias("h")).select(word.alias("word")).filter(F.length("word") >= least_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _dealt(words: DataFrame) -> DataFrame:
    """``back, length, shared, letters, is_point, n``: each word as a point and, for words one longer, as a query, both ways round."""
    size = F.length("word")
    each = []
    for back in (False, True):
        for more in (0, 1):
            half = F.floor((size + more) / 2)
            each.append(
                F.struct(
                    F.lit(back).alias("back"),
                    (size + more).alias("length"),
                    (size + more - half if back else half).cast("int").alias("shared"),
                    (F.reverse("word") if back else F.col("word")).alias("letters"),
                    F.lit(more == 0).alias("is_point"),
                )
            )
    return words.select("n", F.explode(F.array(*each)).alias("x")).select("x.*", "n")


def _known() -> Column:
    return F.expr("left(letters, shared)").alias("known")


def _split(rows: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows with as many shared letters as bring their buckets down to ``most``, and the pairs that edit a letter split by."""
    pairs, fixed = [], []
    while True:
        keyed = rows.withColumn("known", _known())
        keys = [*_BUCKET, "known"]
        large = settle(keyed.groupBy(*keys).count().filter(F.col("count") > most).drop("count"), light=True)
        if large.isEmpty():
            discard(large)
            return reduce(DataFrame.union, [rows, *fixed]), pairs
        hot = settle(keyed.join(large, keys, "left_semi"))
        fixed.append(keyed.join(large, keys, "left_anti").drop("known"))
        # the letter behind the shared ones is the edited one: all others are equal
        left = hot.withColumn("rest", F.expr("if(is_point, substring(letters, shared + 2), substring(letters, shared + 1))"))
        near = left.filter("is_point").select(*keys, "rest", F.col("letters").alias("near"), F.col("n").alias("near_n"))
        here, beside = F.expr("substring(near, shared + 1, 1)"), F.expr("substring(near, if(back, shared + 2, shared), 1)")
        found = left.join(near, [*keys, "rest"]).filter(F.when(F.col("is_point"), F.col("letters") != F.col("near")).otherwise(here != beside))
        pairs.append(found.select("back", "is_point", F.col("letters").alias("word"), "n", "near", "near_n"))
        # a shorter word may end with the shared letters: nothing is left to edit behind them
        rows = hot.filter("shared + 1 < length").withColumn("shared", F.col("shared") + 1).select(rows.columns)


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of all buckets; rows come bucket by bucket."""
    for bunch in _bunches(batches):
        back, length, shared = (bunch.column(c).to_numpy(zero_copy_only=False) for c in _BUCKET)
        cuts = np.flatnonzero((np.diff(length) != 0) | (np.diff(shared) != 0) | (back[1:] != back[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), bunch.num_rows]):
            yield from _pairs(bunch.slice(a, b - a), bool(back[a]), int(length[a]), int(shared[a]))


def _bunches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole buckets, of ``TREE`` code points together or one bucket at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += int(batch.column("length").to_numpy().astype(np.int64).sum())
        if size < TREE:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        last = rows.column("bucket").to_numpy()
        end = int(np.flatnonzero(last != last[-1])[-1]) + 1 if (last != last[-1]).any() else 0
        if end:
            yield rows.slice(0, end)
        held = rows.slice(end).to_batches()
        size = int(rows.column("length").slice(end).to_numpy().astype(np.int64).sum())
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs(rows: pa.Table, back: bool, length: int, shared: int) -> Iterator[pa.RecordBatch]:
    """Pairs of words in rows that agree on all three."""
    is_point = rows.column("is_point").to_numpy(zero_copy_only=False)
    if not is_point.any():
        return
    order = np.argsort(~is_point, kind="stable")
    letters, n = rows.column("letters").take(order), rows.column("n").to_numpy()[order]
    names, k = letters.to_pylist(), int(is_point.sum())
    points = code_points(names[:k], length)
    for i, row, near in Grid(points, code_points(names[k:], length - 1)).edits(shared):
        # of the places where a letter gives the same word, the first in reading order
        beside = i + 1 if back else i - 1
        if 0 <= beside < length:
            keep = (row < k) | (points[near, i] != points[near, beside])
            row, near = row[keep], near[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(row), back)), pa.array(row < k), letters.take(row).combine_chunks(), pa.array(n[row]), letters.take(near).combine_chunks(), pa.array(n[near])],
            ["back", "is_point", "word", "n", "near", "near_n"],
        )


def near(words: DataFrame, most: int | None = None) -> DataFrame:
    """``word, n, near, near_n`` of all pairs that one inserted, deleted or replaced code point apart, both ways round, each once.

    ``words`` has distinct, non-null words and their ``n``; words of less than
    two code points are not compared.  A very long word takes memory in
    proportion to its length, and time too unless long words are near it.
    """
    rows, pairs = _split(_dealt(words.filter(F.length("word") > 1)), most or MOST)
    rows = rows.withColumn("bucket", F.xxhash64(*_BUCKET, _known()))
    dealt = rows.repartition("bucket").sortWithinPartitions(*_BUCKET, "bucket")
    found = in_arrow(dealt, _searched, "back boolean, is_point boolean, word string, n long, near string, near_n long")
    found = reduce(DataFrame.union, [found, *pairs])
    read = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)).alias(c)
    found = found.select("is_point", read("word"), "n", read("near"), "near_n")
    # a pair of one length was found from both sides, others from the shorter word
    ways = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return found.select(F.explode(F.when(F.col("is_point"), F.slice(ways, 1, 1)).otherwise(ways)).alias("x")).select("x.*")


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, times: int = 5, most: int | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words of ``docs`` that are long and frequent enough.

    ``form`` is the near word of greatest count (of equals the first in
    code-point order) if that is at least ``times`` the word's own count, else
    null; ``root`` is where forms lead to in the end, the word itself without
    one.  ``n_near`` counts near words.  No texts, no rows.
    """
    if times < 2:
        raise ValueError("forms must have at least twice the count, or they may lead in circles")
    known = settle(words(docs, least_length, least_count))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    pairs = near(known, most).unionByName(known, allowMissingColumns=True)
    told = pairs.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    ok = -F.col("best.less") >= times * F.col("n")
    told = settle(told.select("word", F.when(ok, F.col("best.near")).alias("form"), "n", "n_near", F.when(ok, -F.col("best.less")).alias("form_n")))
    links = _roots(told.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    found = told.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    discard(known)
    return found


def _roots(links: DataFrame) -> DataFrame:
    """``word, root`` with roots followed to the end; each round doubles the steps taken."""
    links = settle(links, light=True)
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = settle(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), light=True)
        discard(links)
        over = moved.filter("moved").isEmpty()
        links = moved.drop("moved")
        links.settled_path = moved.settled_path
        if over:
            return links


# letters are ASCII or have two bytes in UTF-8
_OCTETS = "flatten(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN ord(substr(s, i, 1)) < 128 THEN [ord(substr(s, i, 1))::BIGINT] ELSE [192 + ord(substr(s, i, 1))::BIGINT // 64, 128 + ord(substr(s, i, 1))::BIGINT % 64] END))"
#: DuckDB SQL for ``variants`` of the table ``documents``.
SQL = f"""{sql.CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '{RUN}')) r FROM documents),
low AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || w s, w, k FROM (SELECT doc_id, translate(r, '{CAPITALS}', '{SMALL}') w, count(*) k FROM runs GROUP BY 1, 2) WHERE length(w) > 5),
hashed AS (SELECT w, k, {sql.crc32(_OCTETS)} h FROM low, crc),
words AS (
  SELECT word, sum(k)::BIGINT n FROM (SELECT k, CASE WHEN h % {DAMAGED} = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w) + 2)::INT) ELSE w END word FROM hashed)
  WHERE length(word) > 5 GROUP BY word HAVING sum(k) > 4),
less AS (SELECT DISTINCT word, i, left(word, i - 1) || substr(word, i + 1) rest FROM words, unnest(range(1, length(word) + 1)) u(i)),
pairs AS (
  SELECT a.word a, b.word b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.rest),
best AS (
  SELECT a word, count(*) n_near, arg_min(b, (-y.n, b)) form, max(y.n) form_n FROM pairs JOIN words y ON y.word = b GROUP BY a),
told AS (SELECT w.word, w.n, coalesce(n_near, 0) n_near, CASE WHEN form_n >= 5 * w.n THEN form END form, CASE WHEN form_n >= 5 * w.n THEN form_n END form_n FROM words w LEFT JOIN best b ON b.word = w.word),
ways(word, root, k) AS (SELECT word, word, 0 FROM told UNION ALL SELECT v.word, t.form, k + 1 FROM ways v JOIN told t ON t.word = v.root WHERE t.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, k) root FROM ways GROUP BY word)
SELECT t.word, t.form, e.root, t.n, t.n_near, t.form_n FROM told t JOIN ends e ON e.word = t.word"""
