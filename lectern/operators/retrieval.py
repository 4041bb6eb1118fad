"""Lexical and dense candidate search, rank fusion, diversification, contexts.

The formulas the reference behaviour leaves to a vector store are parameters
here: BM25 with ``K1`` and ``B``, the usual inverse document frequency, and
reciprocal rank fusion with constant ``RRF_K`` over ranks from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import analysis
from lectern.functions import text as T
from lectern.operators import vectors as V
from lectern.sources.sinks import stage

K1, B, RRF_K, EMPTY_LENGTH = 1.2, 0.75, 2, 256.0
TOP_K, CANDIDATES, PER_PARENT, WINDOW = 8, 30, 2, 1
PARENT_LIMIT, CONTEXT_BUDGET, LEAST_CUT = 1400, 6000, 50
#: Terms that go into a scan as literals; more are joined.
LITERALS = 5000
#: Shares of the vectors that many queries meet.
SHARES = 64
#: Places of shown scores, and of those that ranks go by: sums of one set of terms in another order agree in these.
PLACES, RANK_PLACES = 6, 9

#: The stored fields of a chunk.
PAYLOAD = ("chunk_id", "parent_id", "section_id", "document_id", "chunk_number", "title", "heading_path", "text", "page_start", "page_end", "source_block_ids", "contains_code", "freshness_warning", "source", "citation", "quality_flags", "content_hash", "token_count_approx", "character_count")


def payload(chunks: DataFrame) -> DataFrame:
    """The stored fields of each chunk, as JSON without nulls."""
    fields = [c for c in PAYLOAD if c in chunks.columns]
    return chunks.select("chunk_id", F.to_json(F.struct(*fields)).alias("payload"))


def lexical_text(title: Column, heading_path: Column, text: Column) -> Column:
    """Title, heading path and text on a line each; empty ones are left out."""
    path = F.array_join(F.filter(F.transform(heading_path, T.strip), lambda x: x != ""), " ")
    return T.strip(F.concat_ws("\n", F.nullif(T.strip(title), F.lit("")), F.nullif(path, F.lit("")), T.strip(text)))


def dense_text(embedding: Column, title: Column, heading_path: Column, text: Column) -> Column:
    """The embedding text, or a labelled substitute."""
    path = F.array_join(F.filter(F.transform(heading_path, T.strip), lambda x: x != ""), " > ")
    head = [F.when(T.strip(title) != "", F.concat(F.lit("Title : "), T.strip(title))), F.when(path != "", F.concat(F.lit("Section: "), path))]
    return F.coalesce(F.nullif(T.strip(embedding), F.lit("")), T.strip(F.concat_ws("\n", *head, F.lit(""), T.strip(text))))


def terms(text: Column, language: str | None = None) -> Column:
    """The index terms of a text: its case-folded words, or their stems without stop words in ``language``."""
    return analysis.terms(text, language)


def counted(words: Column) -> Column:
    """``term, tf`` of each distinct word, counted where the words are."""
    return T.runs(F.sort_array(words), lambda w: w, lambda s, a, b: F.struct(F.get(s, a).alias("term"), (b - a).cast("long").alias("tf")))


def average_length(texts: DataFrame, text: str = "text") -> DataFrame:
    """``avg_length``: mean number of words, each text counting 1 at least; ``EMPTY_LENGTH`` without texts."""
    return sizes(texts, text).select("avg_length")


def postings(texts: DataFrame, key: str, text: str = "text", among: DataFrame | None = None, language: str | None = None) -> DataFrame:
    """``key, term, tf, length``; only terms in ``among`` (``term``), if given, which are picked before anything is grouped."""
    if among is not None and language is not None:
        return _stemmed_postings(texts, key, text, among, language)
    words = texts.select(key, terms(F.col(text), language).alias("w"))
    own = F.col("w")
    if among is not None:
        wanted = among.select("term").distinct().limit(LITERALS + 1).collect()
        if len(wanted) <= LITERALS:
            # the words that nobody asked for do not leave their text
            known, among = sorted(r.term for r in wanted), None
            own = F.filter(own, lambda w: w.isin(known))
    rows = words.select(key, F.size("w").alias("length"), F.explode(own).alias("term"))
    if among is not None:
        rows = rows.join(among, "term", "left_semi")
    return rows.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def _stemmed_postings(texts: DataFrame, key: str, text: str, among: DataFrame, language: str) -> DataFrame:
    """As ``postings``: a word is stemmed once in all texts, not each time it stands, and those that become no wanted term do not leave their text."""
    kept = texts.select(key, analysis.words(F.col(text), language).alias("w"))
    # written, or Spark would stem before it leaves repeated words out
    said = stage(kept.select(F.explode(F.array_distinct("w")).alias("word")).distinct())
    known = stage(said.withColumn("term", F.get(analysis.stems(F.array("word"), language), F.lit(0))).join(among.select("term").distinct(), "term", "left_semi"))
    few = [r.word for r in known.select("word").limit(LITERALS + 1).collect()]
    own = F.filter("w", lambda w: w.isin(sorted(few))) if len(few) <= LITERALS else F.col("w")
    counts = kept.select(key, F.size("w").alias("length"), F.explode(own).alias("word")).join(known, "word")
    return counts.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def weight(avg: Column | float, tf: Column | None = None, length: Column | None = None) -> Column:
    """Weight of a posting ``tf, length``; it grows with ``tf`` and falls with ``length``."""
    tf, length = F.col("tf") if tf is None else tf, F.col("length") if length is None else length
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg))


def idf(n: Column, df: Column) -> Column:
    """Inverse document frequency of a term in ``df`` of ``n`` texts."""
    return F.log1p((n - df + 0.5) / (df + 0.5))


def weights(posted: DataFrame, avg: Column | float, truncated: bool = False) -> DataFrame:
    """``weight`` of each posting; ``truncated`` cuts it to an integer, as a strict index would."""
    w = weight(avg)
    return posted.withColumn("weight", F.floor(w) if truncated else w)


def bm25(posted: DataFrame, queries: DataFrame, key: str, size: DataFrame, limit: int = CANDIDATES, language: str | None = None, truncated: bool = False) -> DataFrame:
    """``query_id, key, score, rank`` (from 1) of the best ``limit`` texts of each query.

    ``size`` is one row ``n, avg_length``.  An equi-join on terms; document
    frequencies are those of ``posted`` where it has ``df``, else they are
    counted for the queries' terms only.  The top of each query is cut within
    partitions first.  ``truncated`` cuts the postings' weights to integers.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text"), language))).alias("term"))
    hit = posted.join(asked.select("term").distinct(), "term", "left_semi")
    if "df" not in posted.columns:
        hit = hit.join(hit.groupBy("term").agg(F.count("*").alias("df")), "term")
    hit = hit.withColumn("_one", F.lit(1)).join(F.broadcast(size.select("n", "avg_length", F.lit(1).alias("_one"))), "_one")
    own = weights(hit, F.col("avg_length"), truncated)
    weighted = own.select(key, "term", (idf(F.col("n"), F.col("df")) * F.col("weight")).alias("w"))
    scored = weighted.join(asked, "term").groupBy("query_id", key).agg(F.sum("w").alias("score"))
    return ranked(scored, key, limit)


def sizes(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row ``n, avg_length`` of the texts."""
    return summed(texts, text_length(F.col(text)))


def text_length(text: Column) -> Column:
    """The number of words of a text, 1 at least."""
    return F.greatest(F.lit(1), F.size(terms(F.coalesce(text, F.lit("")))))


def summed(texts: DataFrame, length: Column) -> DataFrame:
    """As ``sizes``, of texts whose lengths are known."""
    return texts.agg(F.count("*").alias("n"), F.coalesce(F.greatest(F.lit(1.0), F.avg(length)), F.lit(EMPTY_LENGTH)).alias("avg_length"))


def ranked(scored: DataFrame, key: str, limit: int) -> DataFrame:
    """Ranks from 1 by score, then by key, of the first ``limit`` of each query; scores come out rounded."""
    order = W.partitionBy("query_id").orderBy(F.desc("_fine"), key)
    fine = scored.withColumn("_fine", F.round("score", RANK_PLACES))
    return fine.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).withColumn("score", F.round("score", PLACES)).drop("_fine")


def dense(vectors: DataFrame, queries: DataFrame, key: str, limit: int = CANDIDATES) -> DataFrame:
    """``query_id, key, score, rank`` by cosine of unit vectors ``embedding``; keys may be longs or strings.

    Vectors are packed into blocks where they are and multiplied with blocks of
    queries, which go to all tasks if they are few and otherwise meet the
    vectors by shares of their keys.
    """
    few = V.few(queries)
    share = F.lit(0) if few else F.pmod(F.xxhash64(key), F.lit(SHARES))
    blocks = V.pack(vectors.select(share.alias("cell"), F.col(key).alias("key"), F.lit(0).alias("tag"), F.col("embedding").cast("array<double>").alias("embedding")))
    return ranked(V.nearest(blocks, V.everywhere(queries, 1 if few else SHARES), limit, key, few), key, limit)


def fuse(lists: list[DataFrame], key: str, limit: int | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists ``query_id, key, rank``."""
    union = lists[0].select("query_id", key, "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select("query_id", key, "rank"))
    scored = union.groupBy("query_id", key).agg(F.sum(1.0 / (k + F.col("rank") - 1)).alias("score"))
    return ranked(scored, key, limit if limit is not None else 2**31 - 1)


def diversify(hits: DataFrame, parent: str = "parent_id", most: int = PER_PARENT, top: int = TOP_K) -> DataFrame:
    """At most ``most`` hits of a parent (any number without one), then the first ``top`` by rank."""
    own = W.partitionBy("query_id", parent).orderBy("rank")
    kept = hits.withColumn("_k", F.row_number().over(own)).filter((F.col("_k") <= most) | F.col(parent).isNull() | (F.col(parent).cast("string") == "")).drop("_k")
    order = W.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top)


def merge_texts(paragraphs: Column) -> Column:
    """One text from ordered lists of paragraphs, without the longest suffix that the next list repeats."""

    def add(acc: Column, new: Column) -> Column:
        most = F.least(F.size(acc), F.size(new))
        normal = lambda a: F.transform(a, T.normalize_for_hash)
        sizes = F.when(most < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(most, F.lit(1))))
        same = F.filter(sizes, lambda k: normal(F.slice(acc, F.size(acc) - k + 1, k)) == normal(F.slice(new, F.lit(1), k)))
        overlap = F.coalesce(F.array_max(same), F.lit(0))
        return F.when(F.size(new) == 0, acc).otherwise(F.concat(acc, F.slice(new, overlap + 1, F.greatest(F.size(new) - overlap, F.lit(0)))))

    return F.array_join(F.aggregate(paragraphs, F.array().cast("array<string>"), add), "\n\n")


def neighbours(hits: DataFrame, chunks: DataFrame, window: int = WINDOW, few: bool = False) -> DataFrame:
    """Per hit the merged text of its parent's chunks at most ``window`` away.

    An equi-join on the parent with the distance as a residual condition; ``few``
    hits are sent to the chunks.
    """
    side = chunks.select("parent_id", F.col("chunk_number").alias("n"), F.col("chunk_id").alias("c"), F.col("text").alias("t"), F.col("page_start").alias("ps"), F.col("page_end").alias("pe"))
    own = hits.select("query_id", "position", "chunk_id", "parent_id", "chunk_number")
    near = (F.broadcast(own) if few else own).join(side, "parent_id").filter(F.abs(F.col("n") - F.col("chunk_number")) <= window)
    got = near.groupBy("query_id", "position").agg(F.array_sort(F.collect_list(F.struct("n", "c", "t"))).alias("a"), F.min("ps").alias("near_start"), F.max("pe").alias("near_end"))
    return got.select("query_id", "position", "near_start", "near_end", F.transform("a", lambda x: x["c"]).alias("near_ids"), merge_texts(F.transform("a", lambda x: T.split_paragraphs(x["t"]))).alias("near_text"))


MODES = ("none", "child", "parent", "neighbors", "auto")


def contexts(hits: DataFrame, parents: DataFrame, chunks: DataFrame, mode: str = "auto", window: int = WINDOW, limit: int = PARENT_LIMIT, few: bool = False) -> DataFrame:
    """Passages of the hits (``query_id, position`` and chunk fields), before the budget.

    All modes but ``child`` keep the first hit of each parent.  ``auto`` takes
    the parent where it has 1 to ``limit`` tokens, and neighbours otherwise.
    ``few`` hits are sent to parents and chunks, whose texts are not dealt then.
    """
    if mode not in MODES:
        raise ValueError(f"unknown context mode {mode!r}; one of {', '.join(MODES)}")
    if mode == "none":
        return hits.limit(0).select("query_id", "position", F.lit("").alias("context_type"), "parent_id", "document_id", "page_start", "page_end", F.array("chunk_id").alias("chunk_ids"), "text")
    if mode != "child":
        first = W.partitionBy("query_id", "parent_id").orderBy("position")
        hits = hits.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")
    own = {"context_type": F.lit("child"), "page_start": F.col("page_start"), "page_end": F.col("page_end"), "chunk_ids": F.array("chunk_id"), "text": F.col("text")}
    if mode == "child":
        return hits.select("query_id", "position", own["context_type"].alias("context_type"), "parent_id", "document_id", "page_start", "page_end", own["chunk_ids"].alias("chunk_ids"), "text")
    if mode == "neighbors":
        # no passage is a parent: none is made
        parents = hits.limit(0).select("parent_id", "text", "page_start", "page_end")
    elif few:
        parents = parents.join(F.broadcast(hits.select("parent_id").distinct()), "parent_id", "left_semi")
    up = parents.select("parent_id", F.col("text").alias("up_text"), F.col("page_start").alias("up_start"), F.col("page_end").alias("up_end"), T.token_count(F.col("text")).alias("up_tokens"))
    rows = hits.join(up, "parent_id", "left").join(neighbours(hits, chunks, window, few), ["query_id", "position"], "left")
    has_near, has_up = F.col("near_text").isNotNull(), F.col("up_text").isNotNull()
    take_up = {"parent": has_up, "neighbors": F.lit(False), "auto": has_up & F.col("up_tokens").between(1, limit)}[mode]
    choose = lambda a, b, c: F.when(take_up, a).when((F.lit(mode) != "parent") & has_near, b).otherwise(c)
    return rows.select(
        "query_id",
        "position",
        choose(F.lit("parent"), F.lit("neighbours"), F.lit("child")).alias("context_type"),
        "parent_id",
        "document_id",
        choose(F.col("up_start"), F.col("near_start"), F.col("page_start")).alias("page_start"),
        choose(F.col("up_end"), F.col("near_end"), F.col("page_end")).alias("page_end"),
        choose(F.array().cast("array<string>"), F.col("near_ids"), F.array("chunk_id")).alias("chunk_ids"),
        choose(F.col("up_text"), F.col("near_text"), F.col("text")).alias("text"),
    )


def within_budget(passages: DataFrame, budget: int = CONTEXT_BUDGET) -> DataFrame:
    """Passages in order while their tokens fit; the one that crosses is cut if ``LEAST_CUT`` tokens are left, what follows is dropped."""
    order = W.partitionBy("query_id").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = passages.withColumn("n", T.token_count(F.col("text"))).withColumn("upto", F.sum("n").over(order))
    left = F.lit(budget) - (F.col("upto") - F.col("n"))
    over = F.col("upto") > budget
    kept = rows.withColumn("left", left).filter(~over | ((F.col("left") >= LEAST_CUT) & (F.col("left") <= budget) & (F.col("upto") - F.col("n") <= budget)))
    cut = F.when(F.col("upto") > budget, T.truncate_tokens(F.col("text"), F.col("left"))).otherwise(F.col("text"))
    done = kept.withColumn("truncated", F.col("upto") > budget).withColumn("text", cut)
    return done.withColumn("token_count_approx", T.token_count(F.col("text"))).drop("n", "upto", "left")
