"""Atoms, overlapping token-bounded chunks, parent and chunk records, deduplication, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T

#: Token limits of the named profiles (maximum, overlap, minimum).
PROFILES = {"case_study": (450, 60, 60), "technical_book": (500, 75, 70), "training_book": (500, 75, 70), "command_reference": (250, 30, 25), "default": (450, 60, 60)}


def resolve_profile(name: str | None = None, manifest: dict | None = None, maximum: int | None = None, overlap: int | None = None) -> tuple[int, int, int]:
    """Limits of a named profile, overridden by the manifest's ``chunking`` and then by the caller."""
    values = dict(zip(("maximum_tokens", "overlap_tokens", "minimum_tokens"), PROFILES.get(name or "default", PROFILES["default"])))
    values |= {k: int(v) for k, v in (manifest or {}).items() if k in values}
    values |= {k: v for k, v in (("maximum_tokens", maximum), ("overlap_tokens", overlap)) if v is not None}
    most, over, least = values["maximum_tokens"], values["overlap_tokens"], values["minimum_tokens"]
    if most <= 0 or over < 0 or over >= most or least < 0:
        raise ValueError(f"chunk limits do not fit together: maximum {most}, overlap {over}, minimum {least}")
    return most, over, least


def blocks_of(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Source blocks of each section in order; ``missing`` marks ids that no block has."""
    wanted = sections.select("document_id", "section_id", F.posexplode("source_block_ids").alias("block_order", "source_block_id"))
    found = blocks.select("document_id", "source_block_id", F.col("text").alias("block_text"), "page_number", "likely_code_block")
    return wanted.join(found, ["document_id", "source_block_id"], "left").withColumn("missing", F.col("block_text").isNull())


def atoms(sections: DataFrame, blocks: DataFrame, most: int) -> DataFrame:
    """Ordered atoms of at most ``most`` tokens; a section none of whose blocks exist is split itself."""
    fields = sections.select("document_id", "section_id", "page_start", "contains_code", F.col("text").alias("whole"), F.posexplode_outer("source_block_ids").alias("block_order", "source_block_id"))
    # the section's own text goes with its first block only
    wanted = fields.withColumn("whole", F.when(F.coalesce("block_order", F.lit(0)) == 0, F.col("whole")))
    found = blocks.select("document_id", "source_block_id", F.col("text").alias("block_text"), "page_number", "likely_code_block")
    own = W.partitionBy("document_id", "section_id")
    # a block has atoms unless it is blank, so which sections have some needs no splitting
    some = F.bool_or(F.coalesce(T.strip(F.col("block_text")) != "", F.lit(False))).over(own)
    rows = wanted.join(found, ["document_id", "source_block_id"], "left").withColumns({"_some": some, "_k": F.row_number().over(own.orderBy("block_order"))})
    texts = T.split_counted(F.when(F.col("_some"), F.col("block_text")).when(F.col("_k") == 1, F.col("whole")), most)
    parts = rows.select("document_id", "section_id", "block_order", "source_block_id", "page_number", "likely_code_block", "page_start", "contains_code", "_some", F.posexplode(texts).alias("part", "a"))
    of = lambda c, other: F.when(F.col("_some"), F.col(c)).otherwise(other).alias(c)
    named = of("source_block_id", F.format_string("section-fallback/%03d", F.col("part") + 1))
    return parts.select("document_id", "section_id", of("block_order", F.lit(0)), named, of("page_number", F.col("page_start")), of("likely_code_block", F.col("contains_code")), "part", F.col("a.text").alias("text"), F.col("a.tokens").alias("token_count"))


def pack(tokens: Column, most: int, overlap: int) -> Column:
    """Inclusive index ranges ``s, e`` of greedy chunks over atoms of the given token counts."""
    sums = F.aggregate(tokens, F.array(F.lit(0).cast("long")), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t)))
    return pack_sums(sums, most, overlap)


def pack_sums(sums: Column, most: int, overlap: int) -> Column:
    """As ``pack``, for prefix sums of the token counts, 0 first.

    A chunk takes atoms while they fit; the next one starts at the earliest
    atom from which what is repeated stays within the overlap and leaves room
    for the atom that did not fit.  With prefix sums that is one comparison.
    """

    def fold(p: Column) -> Column:
        n = F.size(p) - 1
        width = lambda s, i: F.get(p, i) - F.get(p, s)
        start = F.struct(F.lit(0).alias("s"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

        def add(acc: Column, i: Column) -> Column:
            over = width(acc["s"], i + 1) > most
            room = F.least(F.lit(overlap), most - width(i, i + 1))
            behind = F.size(F.filter(F.sequence(acc["s"], i), lambda j: width(j, i) > room))
            ended = F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), (i - 1).alias("e"))))
            return F.when(over & (i > acc["s"]), F.struct((acc["s"] + behind).alias("s"), ended.alias("out"))).otherwise(acc)

        end = lambda acc: F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), (n - 1).alias("e"))))
        empty = F.array().cast("array<struct<s:int,e:int>>")
        return F.when(n < 1, empty).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), start, add, end))

    return T.let(sums, fold)


def chunk(atoms_: DataFrame, most: int, overlap: int, *keys: str) -> DataFrame:
    """``keys, chunk_number, text, token_count, page_start, page_end, contains_code, source_block_ids``; empty texts are left out after numbering."""
    atom = F.struct("block_order", "part", "text", "token_count", "page_number", "likely_code_block", "source_block_id", "upto")
    # prefix sums by a window: an array that grows atom by atom would be copied for each
    order = W.partitionBy(*keys).orderBy("block_order", "part").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = atoms_.withColumn("upto", F.sum("token_count").over(order)).groupBy(*keys).agg(F.array_sort(F.collect_list(atom)).alias("atoms"))
    sums = F.concat(F.array(F.lit(0).cast("long")), F.transform("atoms", lambda a: a["upto"]))
    ranges = rows.select(*keys, "atoms", F.posexplode(pack_sums(sums, most, overlap)).alias("k", "r"))
    own = ranges.select(*keys, (F.col("k") + 1).alias("chunk_number"), F.slice("atoms", F.col("r.s") + 1, F.col("r.e") - F.col("r.s") + 1).alias("a"))
    each = lambda name: F.transform("a", lambda x: x[name])
    return own.select(
        *keys,
        "chunk_number",
        F.array_join(F.filter(F.transform("a", lambda x: T.strip(x["text"])), lambda t: t != ""), "\n\n").alias("text"),
        F.aggregate(each("token_count"), F.lit(0).cast("long"), lambda s, x: s + x).alias("token_count"),
        F.array_min(each("page_number")).alias("page_start"),
        F.array_max(each("page_number")).alias("page_end"),
        F.exists("a", lambda x: F.coalesce(x["likely_code_block"], F.lit(False))).alias("contains_code"),
        F.array_distinct(each("source_block_id")).alias("source_block_ids"),
    ).filter("text <> ''")


def deduplicate(chunks: DataFrame, *order: str, scope: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """The first chunk of each content hash within ``scope`` (empty: the whole corpus)."""
    hashed = chunks if "content_hash" in chunks.columns else chunks.withColumn("content_hash", T.content_hash(F.col("text")))
    place = W.partitionBy(*scope, "content_hash").orderBy(*order)
    return hashed.withColumn("_k", F.row_number().over(place)).filter("_k = 1").drop("_k")


def parents(sections: DataFrame, atoms_: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Parent records of the indexable sections, put together from their atoms.

    A section without atoms (blank text) keeps its pages and has empty text.
    ``documents`` (``document_id, freshness_warning``) gives the warning flag.
    """
    kept = sections.filter(F.coalesce("indexable", F.lit(True))).drop("text", "character_count", "source_block_ids", "contains_code", "citation")
    atom = F.struct("block_order", "part", "text", "page_number", "likely_code_block", "source_block_id")
    own = atoms_.groupBy("document_id", "section_id").agg(F.array_sort(F.collect_list(atom)).alias("a"))
    rows = kept.join(own, ["document_id", "section_id"], "left").withColumn("a", F.coalesce("a", F.expr("filter(array(named_struct('block_order', 0, 'part', 0, 'text', '', 'page_number', 0, 'likely_code_block', false, 'source_block_id', '')), x -> false)")))
    each = lambda name: F.transform("a", lambda x: x[name])
    text = F.array_join(F.filter(F.transform("a", lambda x: T.strip(x["text"])), lambda t: t != ""), "\n\n")
    rows = rows.withColumns({"text": text, "page_start": F.coalesce(F.array_min(each("page_number")), "page_start"), "page_end": F.coalesce(F.array_max(each("page_number")), "page_end")})
    rows = with_freshness(rows, documents)
    return rows.select(
        "schema_version",
        F.col("section_id").alias("parent_id"),
        "section_id",
        "document_id",
        "parent_section_id",
        "title",
        "heading_path",
        "level",
        "page_start",
        "page_end",
        "text",
        F.length("text").cast("long").alias("character_count"),
        T.token_count(F.col("text")).alias("token_count_approx"),
        F.array_distinct(each("source_block_id")).alias("source_block_ids"),
        F.exists("a", lambda x: F.coalesce(x["likely_code_block"], F.lit(False))).alias("contains_code"),
        F.coalesce("indexable", F.lit(True)).alias("indexable"),
        "freshness_warning",
        "source",
        cited("page_start", "page_end").alias("citation"),
        T.content_hash(F.col("text")).alias("content_hash"),
    )


def cited(first: str, last: str) -> Column:
    return F.struct(F.col("source.title").alias("document_title"), F.col("title").alias("section_title"), F.col(first).alias("page_start"), F.col(last).alias("page_end"))


def with_freshness(rows: DataFrame, documents: DataFrame | None) -> DataFrame:
    if documents is None:
        return rows.withColumn("freshness_warning", F.lit(False))
    flagged = documents.select("document_id", F.col("freshness_warning"))
    return rows.join(flagged, "document_id", "left").withColumn("freshness_warning", F.coalesce("freshness_warning", F.lit(False)))


def embedding_text(title: Column, heading_path: Column, year: Column, kind: Column, domain: Column, text: Column) -> Column:
    """Labelled header lines, an empty line, and the text."""
    labelled = lambda label, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(label), c.cast("string")))
    head = (F.concat(F.lit("Document: "), title), F.concat(F.lit("Section: "), F.array_join(heading_path, " > ")))
    return T.strip(F.concat_ws("\n", *head, F.when(year.isNotNull(), F.concat(F.lit("Publication year: "), year.cast("string"))), labelled("Document type: ", kind), labelled("Domain: ", domain), F.lit(""), text))


def chunk_records(sections: DataFrame, atoms_: DataFrame, most: int, overlap: int, least: int, documents: DataFrame | None = None, distinct: bool = True) -> DataFrame:
    """Chunk records of the indexable sections, deduplicated within each document unless ``distinct`` is false.

    ``documents`` (``document_id, title, publication_year, document_type,
    domain, freshness_warning``) gives the embedding text's header; without it
    the sections' source does, and type and domain are left out.
    """
    kept = sections.filter(F.coalesce("indexable", F.lit(True)))
    made = chunk(atoms_, most, overlap, "document_id", "section_id")
    head = kept.select("schema_version", "document_id", "section_id", "title", "heading_path", "section_number", "source")
    if documents is not None:
        head = head.join(documents.select("document_id", F.col("publication_year").alias("_year"), F.col("document_type").alias("_type"), F.col("domain").alias("_domain")), "document_id", "left")
    else:
        head = head.withColumns({"_year": F.col("source.publication_year"), "_type": F.lit(None).cast("string"), "_domain": F.lit(None).cast("string")})
    flags = F.array_compact(F.array(F.when(F.col("token_count") < least, "short-chunk"), F.when(F.col("contains_code"), "contains-code")))
    rows = with_freshness(made.join(head, ["document_id", "section_id"]), documents).withColumn("content_hash", T.content_hash(F.col("text")))
    # what follows from the text is made of the chunks that stay: it is not dealt with them
    rows = deduplicate(rows, "section_number", "chunk_number") if distinct else rows
    return rows.select(
        "schema_version",
        F.concat("section_id", F.format_string("/chunk-%03d", F.col("chunk_number"))).alias("chunk_id"),
        F.col("section_id").alias("parent_id"),
        "section_id",
        "document_id",
        "section_number",
        "chunk_number",
        "title",
        "heading_path",
        "text",
        embedding_text(F.col("source.title"), F.col("heading_path"), F.col("_year"), F.col("_type"), F.col("_domain"), F.col("text")).alias("embedding_text"),
        "page_start",
        "page_end",
        "source_block_ids",
        F.length("text").cast("long").alias("character_count"),
        F.col("token_count").alias("token_count_approx"),
        "contains_code",
        "freshness_warning",
        "source",
        cited("page_start", "page_end").alias("citation"),
        flags.alias("quality_flags"),
        "content_hash",
    )


def report(chunks: DataFrame, *keys: str) -> DataFrame:
    """Counts and token statistics of chunks."""
    n = F.col("token_count_approx")
    return chunks.groupBy(*keys).agg(
        F.count("*").alias("chunk_count"),
        F.coalesce(F.min(n), F.lit(0)).alias("minimum_chunk_tokens"),
        F.coalesce(F.max(n), F.lit(0)).alias("maximum_chunk_tokens"),
        F.coalesce(F.bround(F.avg(n), 2), F.lit(0.0)).alias("average_chunk_tokens"),
        F.count_if(F.array_contains("quality_flags", "short-chunk")).alias("short_chunk_count"),
        F.count_if("contains_code").alias("chunks_with_code_count"),
    )


def full_report(sections: DataFrame, blocks: DataFrame, made: DataFrame) -> DataFrame:
    """Report of every document with sections, from its sections, blocks and chunks before deduplication.

    Adds section, parent and duplicate counts and the distinct missing blocks
    in order; a document without chunks has zeros.
    """
    indexable = F.coalesce("indexable", F.lit(True))
    of_sections = sections.groupBy("document_id").agg(F.count("*").alias("source_section_count"), F.count_if(indexable).alias("indexable_section_count"), F.count_if(indexable).alias("parent_count"))
    absent = blocks_of(sections.filter(indexable), blocks).filter("missing").groupBy("document_id").agg(F.array_sort(F.collect_set("source_block_id")).alias("missing_source_blocks"))
    kept = deduplicate(made, "section_number", "chunk_number")
    every = made.groupBy("document_id").agg(F.count("*").alias("_made"))
    rows = of_sections.join(report(kept, "document_id"), "document_id", "left").join(every, "document_id", "left").join(absent, "document_id", "left")
    rows = rows.fillna(0, [c for c in rows.columns if c.endswith(("_count", "_tokens", "_made"))])
    rows = rows.withColumn("missing_source_blocks", F.coalesce("missing_source_blocks", F.array().cast("array<string>")))
    return rows.withColumns({"duplicate_chunk_count": F.col("_made") - F.col("chunk_count"), "missing_source_block_count": F.size("missing_source_blocks").cast("long")}).drop("_made")
