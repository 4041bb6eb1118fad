"""One query per operator over the driver's tables, and the SQL that DuckDB runs for it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking, encoders, headings, index, layout, retrieval, sections, tables, validate, vectors
from lectern.plans import sql
from lectern.plans.sql import LEAST, LOST, MOST, OVER
from lectern.sources import fixtures, html
from lectern.sources.fixtures import table
from lectern.sources.sinks import dealt, own_folder, release, stage

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.block_rows(_docs(spark, d))


class Corpus:
    """The stages of one query over the documents, each written once; ``lost`` takes blocks away before chunking."""

    def __init__(self, spark: SparkSession, d: str, lost: str | None = None):
        self.documents = fixtures.records(_docs(spark, d))
        # a document's rows stay together from here on: stages are kept by document, so windows and joins within it deal nothing anew
        self.blocks = fixtures.block_rows(_docs(spark, d), lambda rows: dealt(rows, "document_id"))
        self.lost = lost

    @cached_property
    def units(self) -> DataFrame:
        return stage(layout.units(self.blocks), "document_id")

    @cached_property
    def events(self) -> DataFrame:
        found = headings.with_parents(headings.font_events(self.units), headings.FONT_LEVELS)
        return stage(headings.with_level_paths(found, headings.FONT_LEVELS), "document_id")

    @cached_property
    def sections(self) -> DataFrame:
        return stage(sections.build(self.units, self.events, documents=self.documents, together=True), "document_id")

    @cached_property
    def found(self) -> DataFrame:
        return self.units if self.lost is None else self.units.filter(f"NOT ({self.lost})")

    @cached_property
    def atoms(self) -> DataFrame:
        return chunking.atoms(self.sections.filter("indexable"), self.found, MOST)

    @cached_property
    def parents(self) -> DataFrame:
        return chunking.parents(self.sections, self.atoms, self.documents)

    def parents_of(self, hits: DataFrame) -> DataFrame:
        """The parents of hits ``document_id, parent_id``; where these are few, only their sections are put together."""
        if not vectors.few(hits, index.SENT * retrieval.TOP_K):
            return self.parents
        wanted = hits.select("document_id", F.col("parent_id").alias("section_id")).distinct()
        own = self.sections.join(F.broadcast(wanted), ["document_id", "section_id"], "left_semi")
        found = self.found.join(F.broadcast(wanted.select("document_id").distinct()), "document_id", "left_semi")
        return chunking.parents(own, chunking.atoms(own.filter("indexable"), found, MOST), self.documents)

    def release(self) -> None:
        """Take the written stages away, when nothing is made of them any more."""
        for name in ("units", "events", "sections"):
            if name in self.__dict__:
                release(self.__dict__.pop(name))

    def made(self, distinct: bool = True) -> DataFrame:
        return chunking.chunk_records(self.sections, self.atoms, MOST, OVER, LEAST, self.documents, distinct)

    @cached_property
    def chunks(self) -> DataFrame:
        return self.made()


def _units(spark: SparkSession, d: str) -> DataFrame:
    return layout.units(_blocks(spark, d))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return Corpus(spark, d).events


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return Corpus(spark, d).sections


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return Corpus(spark, d).chunks


def _h1(c: str = "html"):
    return F.regexp_extract(c, "(?s)<h1>(.*?)</h1>", 1)


@query
def token_count(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.word_count(F.col("text")).alias("words"))


@query
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.concat("html", F.lit("\r\nx\r"))
    return table(spark, d, "pages").select("page_id", F.length(T.clean_value(dirty)).cast("long").alias("n"), F.md5(T.clean_value(dirty)).alias("digest"))


@query
def collapse_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.collapse_whitespace(F.col("text"))).alias("digest"))


@query
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.slugify(_h1()).alias("slug"))


@query
def title_variants(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    lead = F.when(k == 0, F.concat(F.lit("Chapter "), F.col("doc_id").cast("string"), F.lit(": "))).when(k == 1, "Appendix B - ").when(k == 2, "Part iv. ").otherwise("")
    title = F.concat(lead, F.left(F.substring_index("text", "\n", 1), F.lit(60)))
    return _docs(spark, d).select("doc_id", F.array_join(T.title_variants(title), " | ").alias("variants"))


@query
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query
def stable_point_id(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.point_id(fixtures.document_id()).alias("point_id"))


@query
def preview(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.preview(F.col("text")).alias("preview"))


@query
def file_digest(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha256"))


@query
def block_flatten(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.block_rows(_docs(spark, d))
    nested = rows.groupBy("document_id", "page_number").agg(F.collect_list(F.struct("block_index", "text", F.lit(False).alias("is_repeated_margin"))).alias("blocks"))
    return layout.flatten(nested).select("document_id", "page_number", "block_index", "source_block_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query
def unit_numbering(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select("document_id", "source_block_id", "global_index")


@query
def command_lines(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.command_lines(_docs(spark, d)).filter(layout.is_command(F.col("text"))).select("document_id", "pos", "text")


@query
def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    lines = fixtures.command_lines(_docs(spark, d)).withColumn("block", F.floor(F.col("pos") / 5).cast("int"))
    return layout.classify_code(lines, "document_id", "block")


@query
def margin_signatures(spark: SparkSession, d: str) -> DataFrame:
    return layout.repeated_margins(fixtures.book_pages(_docs(spark, d)))


@query
def margin_removal(spark: SparkSession, d: str) -> DataFrame:
    return layout.remove_margins(fixtures.book_pages(_docs(spark, d)))


def _book(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pages of books without repeated margins, with images, tables and failures."""
    blocks = fixtures.book_pages(_docs(spark, d))
    marked = layout.mark_margins(blocks).withColumn("likely_code_block", layout.is_command(F.col("text")))
    pages = blocks.select("document_id", "page_number", F.lit(612.0).alias("width"), "height", F.lit(0).alias("rotation")).distinct()
    n = F.col("page_number")
    images = pages.filter(n % 5 == 0).select("document_id", "page_number", F.explode(F.sequence(F.lit(1), F.when(n % 10 == 0, 2).otherwise(1))).alias("image_index"))
    images = images.select("document_id", "page_number", F.concat("document_id", F.format_string("/page-%04d/image-%03d", n, F.col("image_index"))).alias("image_id"), ((n % 7) * 0.2 + F.col("image_index") * 0.1).alias("page_coverage_ratio"))
    tables = pages.filter(n % 6 == 1).select("document_id", "page_number", F.concat("document_id", F.format_string("/page-%04d/table-001", n)).alias("table_id"))
    errors = pages.filter(n % 97 == 3).select("document_id", "page_number", F.lit("cannot be read").alias("extraction_error"))
    return layout.page_records(pages, marked, images, tables, errors), images, tables, layout.repeated_margins(blocks)


@query
def page_records(spark: SparkSession, d: str) -> DataFrame:
    made = _book(spark, d)[0]
    return made.select("document_id", "page_number", "width", "height", "rotation", "character_count", "word_count", "has_native_text", "extraction_method", "image_count", "max_image_coverage_ratio", "table_count", "extraction_error", "removed_count", "has_code", F.array_join("image_ids", ",").alias("image_ids"), F.array_join("table_ids", ",").alias("table_ids"), F.array_join("removed_margin_text", "|").alias("removed"), F.md5("text").alias("digest"))


@query
def page_report(spark: SparkSession, d: str) -> DataFrame:
    pages, images, tables, repeated = _book(spark, d)
    toc = pages.filter("page_number % 4 = 0").select("document_id", F.col("page_number").alias("toc_order"))
    made = layout.extraction_report(stage(pages), toc, images, tables, repeated).drop("generated_at")
    lists = [c for c, kind in made.dtypes if kind.startswith("array")]
    return made.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|" if c == "warnings" else ",") for c in lists})


@query
def page_grids(spark: SparkSession, d: str) -> DataFrame:
    """Tables in nested pages of the documents' lines."""
    made = tables.tables(tables.spans_of(fixtures.page_spans(_docs(spark, d), lambda rows: dealt(rows, "document_id"))))
    text = F.array_join(F.transform("cells", lambda r: F.array_join(r, "\t")), "\n")
    return made.select("table_id", "document_id", "page_number", "table_index", F.array_join(F.transform("bbox", lambda x: x.cast("int").cast("string")), ",").alias("bbox"), "row_count", "column_count", F.md5(text).alias("cells_md5"), F.md5("markdown").alias("markdown_md5"), "error")


@query
def body_font_size(spark: SparkSession, d: str) -> DataFrame:
    return headings.body_font_size(_units(spark, d))


@query
def heading_candidates(spark: SparkSession, d: str) -> DataFrame:
    return headings.with_body(_units(spark, d)).filter(headings.is_candidate(F.col("body_font_size"))).select("document_id", "global_index", T.collapse_whitespace(F.col("text")).alias("title"))


@query
def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    return headings.with_body(_units(spark, d)).select("document_id", "global_index", headings.level(F.col("body_font_size")).alias("level"))


@query
def level_stack_parent(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("document_id", "event_id", "level", "parent_event_id")


@query
def heading_path(spark: SparkSession, d: str) -> DataFrame:
    return headings.heading_paths(_events(spark, d).drop("heading_path")).select("document_id", "event_id", F.array_join("heading_path", " > ").alias("heading_path"))


@query
def heading_similarity(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "pages")
    return b.select("page_id", T.heading_similarity(T.title_variants(F.concat(F.lit("Chapter 1: "), _h1())), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("similarity"))


def _toc(blocks: DataFrame) -> DataFrame:
    size = F.col("font_size")
    rows = blocks.filter(size > 10)
    order = F.row_number().over(headings.W.partitionBy("document_id").orderBy("pos"))
    lv = F.when(size == 16, 1).when(size == 12, 2).otherwise(3)
    return headings.toc_parents(rows.select("document_id", order.alias("toc_order"), F.col("text").alias("title"), lv.alias("level"), "page_number"), headings.FONT_LEVELS)


@query
def toc_parents(spark: SparkSession, d: str) -> DataFrame:
    return _toc(_blocks(spark, d)).select("document_id", "toc_id", "level", "parent_toc_id")


@query
def toc_anchor(spark: SparkSession, d: str) -> DataFrame:
    units = Corpus(spark, d).units
    return headings.toc_anchors(_toc(units), units)


@query
def section_intervals(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus(spark, d)
    return sections.assign(c.units, c.events, together=True).select("document_id", "global_index", "event_id")


@query
def section_records(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus(spark, d)
    made = sections.build(c.units, c.events, documents=c.documents, tables=fixtures.page_tables(c.units), together=True)
    keep = ("schema_version", "document_id", "section_id", "parent_section_id", "section_number", "title", "level", "page_start", "page_end", "character_count", "word_count", "contains_code", "indexable")
    joined = [F.array_join(n, sep).alias(n) for n, sep in (("heading_path", " > "), ("source_block_ids", ","), ("table_ids", ","), ("quality_flags", ","))]
    return made.select(*keep, *joined, F.md5("text").alias("digest"), "detection.method", "detection.anchor_page", "detection.anchor_block_id", "detection.anchor_score", *_source(), *_citation())


def _source() -> list:
    return [F.col(f"source.{n}").alias(f"source_{n.removeprefix('source_')}") for n in ("title", "author", "publication_year", "source_filename", "source_sha256")]


def _citation() -> list:
    return [F.concat_ws("|", "citation.document_title", "citation.section_title", F.col("citation.page_start").cast("string"), F.col("citation.page_end").cast("string")).alias("citation")]


@query
def section_table_ids(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus(spark, d)
    return sections.table_ids(c.sections, fixtures.page_tables(c.units)).select("document_id", "section_id", F.array_join("table_ids", ",").alias("table_ids"))


@query
def indexable_titles(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("document_id", "event_id", T.is_indexable_title(F.col("title")).alias("indexable"))


@query
def section_report(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus(spark, d)
    modes = c.documents.select("document_id", F.lit("font").alias("detection_mode"))
    none = modes.select("document_id", F.array().cast("array<string>").alias("warnings")).limit(0)
    made = sections.full_report(c.sections, c.events, headings.body_font_size(c.units), modes, none)
    return made.withColumn("warnings", F.array_join("warnings", "|"))


@query
def warned_report(spark: SparkSession, d: str) -> DataFrame:
    """Section reports of documents whose outlines have entries that were not found: every third."""
    c = Corpus(spark, d)
    toc = _toc(c.units)
    found = toc.withColumn("anchor_index", F.when(F.col("toc_order") % 3 > 0, F.col("toc_order")))
    modes = c.documents.select("document_id", F.lit("toc").alias("detection_mode"))
    made = sections.full_report(c.sections, c.events, headings.body_font_size(c.units), modes, headings.toc_warnings(found, toc))
    return made.select("document_id", "detection_mode", "section_count", F.size("warnings").alias("n_warnings"), F.array_join("warnings", "|").alias("warnings"))


def _outlines(spark: SparkSession, d: str) -> tuple[Corpus, DataFrame, DataFrame]:
    """Documents in turn in toc, font and auto mode; every fourth has no outline, and some entries point beyond the last page."""
    c = Corpus(spark, d)
    n = F.substring("document_id", 5, 6).cast("int")
    toc = _toc(c.units).filter(n % 4 != 3).withColumn("page_number", F.when(F.col("toc_order") % 9 == 8, F.col("page_number") + 1000).otherwise(F.col("page_number")))
    asked = F.when(n % 3 == 0, "toc").when(n % 3 == 1, "font").otherwise("auto")
    return c, toc, headings.detection_modes(c.documents.withColumn("section_detection", asked), toc)


@query
def detection_modes(spark: SparkSession, d: str) -> DataFrame:
    return _outlines(spark, d)[2]


@query
def toc_sections(spark: SparkSession, d: str) -> DataFrame:
    c, toc, modes = _outlines(spark, d)
    events, _ = headings.detect(c.units, stage(toc), modes)
    made = sections.build(c.units, stage(events), documents=c.documents)
    return made.select("document_id", "section_id", "parent_section_id", "title", F.array_join("heading_path", " > ").alias("heading_path"), "page_start", "page_end", "indexable", "detection.method", F.array_join("quality_flags", ",").alias("quality_flags"), F.md5("text").alias("digest"))


@query
def toc_warnings(spark: SparkSession, d: str) -> DataFrame:
    c, toc, modes = _outlines(spark, d)
    toc = stage(toc.join(modes.filter("detection_mode = 'toc'").select("document_id"), "document_id", "left_semi"))
    return headings.toc_warnings(headings.toc_anchors(toc, c.units), toc).withColumn("warnings", F.array_join("warnings", "|"))


def _doc_atoms(spark: SparkSession, d: str) -> DataFrame:
    parts = _blocks(spark, d).select("document_id", F.col("pos").alias("block_order"), "page_number", "source_block_id", F.lit(False).alias("likely_code_block"), F.posexplode(T.split_tokens(F.col("text"), MOST)).alias("part", "text"))
    return parts.withColumn("token_count", T.token_count(F.col("text")))


@query
def split_oversized(spark: SparkSession, d: str) -> DataFrame:
    return _doc_atoms(spark, d).select("document_id", F.col("block_order").alias("pos"), "part", F.col("token_count").alias("tokens"), F.md5("text").alias("digest"))


@query
def section_atoms(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus(spark, d)
    return c.atoms.select("document_id", "section_id", "source_block_id", "part", "page_number", "token_count")


@query
def overlap_chunks(spark: SparkSession, d: str) -> DataFrame:
    made = chunking.chunk(_doc_atoms(spark, d), MOST, OVER, "document_id")
    return made.select("document_id", "chunk_number", "token_count", "page_start", "page_end", T.content_hash(F.col("text")).alias("content_hash"))


def _parent_fields(parents: DataFrame) -> DataFrame:
    keep = ("schema_version", "document_id", "parent_id", "parent_section_id", "title", "level", "page_start", "page_end", "character_count", "token_count_approx", "contains_code", "indexable", "freshness_warning", "content_hash")
    return parents.select(*keep, F.array_join("heading_path", " > ").alias("heading_path"), F.array_join("source_block_ids", ",").alias("source_block_ids"), F.md5("text").alias("digest"), *_source(), *_citation())


@query
def parent_records(spark: SparkSession, d: str) -> DataFrame:
    return _parent_fields(Corpus(spark, d).parents)


@query
def parent_records_lost(spark: SparkSession, d: str) -> DataFrame:
    """Parents where code blocks, and all blocks of some sections, are missing."""
    return _parent_fields(Corpus(spark, d, LOST).parents)


@query
def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    keep = ("schema_version", "chunk_id", "parent_id", "section_id", "document_id", "chunk_number", "title", "page_start", "page_end", "character_count", "token_count_approx", "contains_code", "freshness_warning", "content_hash")
    return _chunks(spark, d).select(*keep, F.array_join("heading_path", " > ").alias("heading_path"), F.array_join("source_block_ids", ",").alias("source_block_ids"), F.array_join("quality_flags", ",").alias("quality_flags"), F.md5("embedding_text").alias("embedding_digest"), *_source(), *_citation())


@query
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", F.md5("embedding_text").alias("digest"))


@query
def lexical_text(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("chunk_id", F.md5(retrieval.lexical_text(F.col("title"), F.col("heading_path"), F.col("text"))).alias("digest"))


@query
def payload(spark: SparkSession, d: str) -> DataFrame:
    """All stored fields, read back from their JSON."""
    chunks = _chunks(spark, d)
    stored = retrieval.payload(chunks)
    fields = chunks.select(*retrieval.PAYLOAD).schema
    p = stored.select(F.from_json("payload", fields).alias("p")).select("p.*")
    keep = [c for c in retrieval.PAYLOAD if c not in ("heading_path", "text", "source_block_ids", "source", "citation", "quality_flags")]
    return p.select(*keep, F.array_join("heading_path", " > ").alias("heading_path"), F.array_join("source_block_ids", ",").alias("source_block_ids"), F.array_join("quality_flags", ",").alias("quality_flags"), F.md5("text").alias("digest"), *_source(), *_citation())


@query
def chunk_dedup(spark: SparkSession, d: str) -> DataFrame:
    return chunking.deduplicate(_docs(spark, d), "doc_id", scope=("source",)).select("doc_id", "content_hash")


@query
def chunk_report(spark: SparkSession, d: str) -> DataFrame:
    """Full reports where code blocks, and all blocks of some sections, are missing."""
    c = Corpus(spark, d, LOST)
    return chunking.full_report(c.sections, c.found, stage(c.made(distinct=False), "document_id")).withColumn("missing_source_blocks", F.array_join("missing_source_blocks", ","))


@query
def missing_blocks(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus(spark, d)
    return chunking.blocks_of(c.sections, c.units.filter("NOT likely_code_block")).filter("missing").select("document_id", "section_id", "source_block_id")


@query
def avg_doc_length(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.average_length(_docs(spark, d)).select(F.bround("avg_length", 4).alias("avg_length"))


@query
def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(_docs(spark, d), "doc_id")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _lexical(texts: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    wanted = asked.select(F.explode(retrieval.terms(F.col("text"))).alias("term")).distinct()
    return retrieval.bm25(retrieval.postings(texts, key, among=wanted), asked, key, retrieval.sizes(texts))


#: Languages by the code that documents carry.
SPOKEN = {"en": "english", "de": "german", "fr": "french", "es": "spanish"}


@query
def stemmed_terms(spark: SparkSession, d: str) -> DataFrame:
    """The terms of each document in its own language."""
    own = F.coalesce(*(F.when(F.col("lang") == code, retrieval.terms(F.col("text"), name)) for code, name in SPOKEN.items()), retrieval.terms(F.col("text")))
    return _docs(spark, d).select("doc_id", F.size(own).cast("long").alias("n_terms"), F.md5(F.array_join(own, " ")).alias("digest"))


@query
def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over English stems; the average length counts words."""
    wanted = _asked(spark, d).select(F.explode(retrieval.terms(F.col("text"), "english")).alias("term"))
    # read for the document frequencies and for the scores
    posted = stage(retrieval.postings(_docs(spark, d), "doc_id", among=wanted, language="english"))
    return retrieval.bm25(posted, _asked(spark, d), "doc_id", retrieval.sizes(_docs(spark, d)), language="english").select("query_id", "doc_id", "score", "rank")


@query
def bm25_truncated(spark: SparkSession, d: str) -> DataFrame:
    """Weights cut to integers, as an index of integer weights has them."""
    posted = retrieval.postings(_docs(spark, d), "doc_id")
    return retrieval.bm25(posted, _asked(spark, d), "doc_id", retrieval.sizes(_docs(spark, d)), truncated=True).select("query_id", "doc_id", "score", "rank")


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(_docs(spark, d), _asked(spark, d), "doc_id").select("query_id", "doc_id", "score", "rank")


def _probes(rows: DataFrame) -> DataFrame:
    return rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return retrieval.dense(v, _probes(v), "vec_id")


def _celled(spark: SparkSession, d: str) -> tuple:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("tag"), "embedding")
    centre, probes = vectors.centroids(v, v.count(), v.select(F.size("embedding").alias("d")).first().d)
    # sorted by cell, so that blocks are as full as they may be
    celled = vectors.with_cells(v, centre).repartitionByRange("cell", "key").sortWithinPartitions("cell")
    return stage(vectors.pack(celled)), centre, probes


def _full(asked: DataFrame, blocks: DataFrame, cells: int) -> DataFrame:
    """A search of all cells: queries are sent once, not for each cell, unless they are too many to be sent."""
    once = vectors.few(asked, vectors.SENT_ONCE)
    return vectors.nearest(blocks, vectors.everywhere(asked, None if once else cells), retrieval.CANDIDATES, "vec_id", once)


@query
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Packed cells searched in full: the rows of ``dense_topk``."""
    blocks, centre, _ = _celled(spark, d)
    asked = _probes(table(spark, d, "embeddings"))
    return retrieval.ranked(_full(asked, blocks, len(centre)), "vec_id", retrieval.CANDIDATES).select("query_id", "vec_id", "score", "rank")


@query
def vector_recall(spark: SparkSession, d: str) -> DataFrame:
    """For each query, how many of its exact neighbours a search of the suggested number of cells finds."""
    blocks, centre, probes = _celled(spark, d)
    asked = _probes(table(spark, d, "embeddings"))
    top = lambda found: retrieval.ranked(found, "vec_id", retrieval.CANDIDATES).select("query_id", "vec_id")
    near = top(vectors.nearest(blocks, vectors.aimed(asked, centre, probes), retrieval.CANDIDATES, "vec_id", vectors.few(asked)))
    exact = top(_full(asked, blocks, len(centre)))
    return exact.join(near.withColumn("found", F.lit(1)), ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("found").alias("found"))


@query
def dense_projected(spark: SparkSession, d: str) -> DataFrame:
    """Documents near the benchmark items by a projection fitted on the documents."""
    model = encoders.fit(_docs(spark, d), "doc_id", "text")
    return retrieval.dense(model.documents(_docs(spark, d), "doc_id", "text"), model.queries(_asked(spark, d), "query_id", "text"), "doc_id").select("query_id", "doc_id", "score", "rank")


@query
def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return retrieval.dense(v.filter("label = 3"), _probes(v), "vec_id")


def _fused(spark: SparkSession, d: str, limit: int | None) -> DataFrame:
    v = table(spark, d, "embeddings")
    asked = table(spark, d, "benchmark").join(v, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "embedding")
    near = retrieval.dense(v, asked, "vec_id").withColumnRenamed("vec_id", "doc_id")
    return retrieval.fuse([_lexical(_docs(spark, d), _asked(spark, d), "doc_id"), near], "doc_id", limit)


@query
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, None)


@query
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    hits = _fused(spark, d, retrieval.CANDIDATES).join(_docs(spark, d).select("doc_id", F.col("source").alias("parent_id")), "doc_id")
    return retrieval.diversify(hits).select("query_id", "doc_id", "parent_id", "score", "position")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    return t.select(F.format_string("conv-%06d/turn-%03d", "conv_id", "turn").alias("chunk_id"), F.format_string("conv-%06d", "conv_id").alias("parent_id"), F.col("role").alias("document_id"), F.col("turn").alias("chunk_number"), "text", F.col("turn").alias("page_start"), F.col("turn").alias("page_end"))


def _convs(turns: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("chunk_number", "text")))
    return turns.groupBy("parent_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))


def _hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    turns = _turns(spark, d)
    found = _lexical(turns, _asked(spark, d), "chunk_id").select("query_id", "chunk_id", "rank")
    return retrieval.diversify(found.join(turns, "chunk_id")), turns


@query
def diversify(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d)[0].select("query_id", "chunk_id", "parent_id", "position")


def _context(spark: SparkSession, d: str, mode: str, limit: int = retrieval.PARENT_LIMIT) -> DataFrame:
    hits, turns = _hits(spark, d)
    return retrieval.contexts(hits, _convs(turns), turns, mode, limit=limit)


def _shown(passages: DataFrame) -> DataFrame:
    return passages.select("query_id", "position", "context_type", "parent_id", "page_start", "page_end", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.sha2("text", 256).alias("text_sha256"))


@query
def context_child(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_context(spark, d, "child"))


@query
def context_parent(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_context(spark, d, "parent"))


@query
def context_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_context(spark, d, "neighbors"))


@query
def context_auto(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_context(spark, d, "auto", limit=300))


@query
def merge_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d, "neighbors").select("query_id", "position", F.sha2("text", 256).alias("text_sha256"))


@query
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.within_budget(_context(spark, d, "auto", limit=300), 600).select("query_id", "position", "truncated", "token_count_approx")


@query
def truncate_budget(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.truncate_tokens(F.col("text"), 100)).alias("digest"))


@query
def validate_corpus(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d)
    return validate.violations(_convs(turns), turns.withColumn("chunk_id", F.col("parent_id")))


@query
def orphan_chunks(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d)
    return validate.orphans(turns.filter("chunk_number = 4").select("parent_id"), turns).select("chunk_id")


@query
def index_report(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus(spark, d)
    # of a chunk its document and length stay, and each indexable section is a parent: no text is kept for the counts
    words = retrieval.text_length(retrieval.lexical_text(F.col("title"), F.col("heading_path"), F.col("text")))
    chunks = stage(c.chunks.select("document_id", words.alias("words")))
    return validate.index_report(c.sections.filter("indexable"), chunks, retrieval.summed(chunks, F.col("words")).select("avg_length"), 64)


def _kept(chunks: DataFrame) -> DataFrame:
    """Chunks written once; of an embedding text that ends with the chunk's text only what comes before that is kept."""
    text, whole = F.col("text"), F.col("embedding_text")
    ends = F.endswith(whole, text)
    head = F.when(ends, F.left(whole, F.length(whole) - F.length(text))).otherwise(whole)
    rows = stage(chunks.withColumns({"_ends": ends, "embedding_text": head}))
    return rows.withColumn("embedding_text", F.when(F.col("_ends"), F.concat(whole, text)).otherwise(whole)).drop("_ends")


def _index(spark: SparkSession, d: str, language: str | None = None) -> tuple[Corpus, index.Index]:
    c = Corpus(spark, d)
    path = own_folder(spark, "index")
    index.build(_kept(c.chunks), path, language=language)
    return c, index.Index(spark, path)


@query
def index_points(spark: SparkSession, d: str) -> DataFrame:
    own = _index(spark, d)[1]
    rows = own.points.join(own.embeddings.select("chunk_id", "embedding"), "chunk_id").select("id", "chunk_id", "content_hash", F.posexplode("embedding").alias("k", "v"))
    return rows.filter("round(v, 6) <> 0").select("id", "chunk_id", "content_hash", "k", F.round("v", 6).alias("v"))


@query
def index_postings(spark: SparkSession, d: str) -> DataFrame:
    c, own = _index(spark, d)
    c.release()
    return own.postings.select("chunk_id", "term", "tf", "length", "df")


@query
def index_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d)[1].statistics.select("n", F.bround("avg_length", 4).alias("avg_length"))


@query
def search_hits(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d)[1].search(_asked(spark, d)).select("query_id", "chunk_id", "parent_id", "score", "rank", "position")


@query
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Only documents of even number, in both branches."""
    even = F.substring("document_id", 5, 6).cast("int") % 2 == 0
    return _index(spark, d)[1].search(_asked(spark, d), document=even).select("query_id", "chunk_id", "parent_id", "score", "rank", "position")


@query
def search_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """Stems and stop words of English on both sides; the lexical branch alone."""
    return _index(spark, d, "english")[1].spoken(_asked(spark, d)).select("query_id", "chunk_id", "score", "rank")


@query
def search_updated(spark: SparkSession, d: str) -> DataFrame:
    """An index of older chunks, some of them changed or gone since, after an update: the hits are those of a new index."""
    c = Corpus(spark, d)
    chunks, path = _kept(c.chunks), own_folder(spark, "index")
    c.release()
    even = F.substring("document_id", 5, 6).cast("int") % 2 == 0
    stale = F.col("chunk_number") % 3 == 0
    older = {c: F.when(stale, F.concat(c, F.lit(" stale"))).otherwise(F.col(c)) for c in ("text", "embedding_text", "content_hash")}
    gone = chunks.filter(~even).withColumn("chunk_id", F.concat(F.lit("gone/"), "chunk_id"))
    index.build(chunks.filter(even).withColumns(older).unionByName(gone), path)
    index.update(chunks, path, removed=gone.select("chunk_id"))
    return index.Index(spark, path).search(_asked(spark, d)).select("query_id", "chunk_id", "parent_id", "score", "rank", "position")


@query
def search_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Two segments folded into one, then stale folders removed."""
    chunks, path = _kept(Corpus(spark, d).chunks), own_folder(spark, "index")
    even = F.substring("document_id", 5, 6).cast("int") % 2 == 0
    index.build(chunks.filter(even), path)
    index.update(chunks.filter(~even), path)
    index.compact(path, spark)
    index.vacuum(path, spark)
    return index.Index(spark, path).search(_asked(spark, d)).select("query_id", "chunk_id", "parent_id", "score", "rank", "position")


@query
def index_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What the manifest tells, with all document ids, which it lists up to a number only."""
    own = _index(spark, d)[1]
    told = index.described(spark, own.path)
    row = spark.createDataFrame([(told["document_count"], told["chunk_count"], told["bm25_average_document_length"], told["dense_dimension"])], "document_count long, chunk_count long, average_lexical_length double, dense_dimension int")
    return row.crossJoin(own.documents.agg(F.array_join(F.array_sort(F.collect_list("document_id")), ",").alias("document_ids")))


@query
def search_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of overlapping chunks, merged, within a budget."""
    c, found = _index(spark, d)
    passages = found.answer(_asked(spark, d), c.parents, "neighbors", budget=900)[1]
    return passages.select("query_id", "position", "context_type", "parent_id", "page_start", "page_end", F.array_join("chunk_ids", ",").alias("chunk_ids"), "truncated", "token_count_approx")


@query
def search_merged_text(spark: SparkSession, d: str) -> DataFrame:
    """The texts of overlapping neighbours around the hits, each repeated passage once, before any budget."""
    c, own = _index(spark, d)
    passages = retrieval.contexts(stage(own.search(_asked(spark, d))), c.parents, own.points, "neighbors", few=vectors.few(_asked(spark, d), index.SENT))
    return passages.select("query_id", "position", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.sha2("text", 256).alias("text_sha256"))


@query
def search_auto(spark: SparkSession, d: str) -> DataFrame:
    c, found = _index(spark, d)
    passages = found.answer(_asked(spark, d), c.parents_of, "auto", parent_limit=250)[1]
    return passages.select("query_id", "position", "context_type", "parent_id", "page_start", "page_end", F.array_join("chunk_ids", ",").alias("chunk_ids"), "truncated", "token_count_approx")


@query
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return html.blocks(table(spark, d, "pages")).select("page_id", "block_index", "level", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query
def html_outline(spark: SparkSession, d: str) -> DataFrame:
    rows = headings.toc_parents(html.outline(html.blocks(table(spark, d, "pages"))))
    return rows.select("document_id", "toc_id", "parent_toc_id", "level", "title")


@query
def context_none(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_context(spark, d, "none"))


@query
def content_range(spark: SparkSession, d: str) -> DataFrame:
    return layout.units(_blocks(spark, d), 2, 3).select("document_id", "source_block_id", "global_index")


@query
def font_statistics(spark: SparkSession, d: str) -> DataFrame:
    spans = _blocks(spark, d).withColumn("is_bold", F.col("bold_ratio") > 0).withColumn("is_monospaced", F.col("monospaced_ratio") > 0)
    return layout.font_statistics(spans, "document_id", "page_number")


@query
def font_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Characters by half-point size, in each document and on each page."""
    spans = _blocks(spark, d).withColumn("font_size", F.col("font_size") + F.col("page_number") % 4 * 0.25)
    return layout.font_histogram(spans, "document_id", "page_number")


@query
def manual_chapters(spark: SparkSession, d: str) -> DataFrame:
    units = Corpus(spark, d).units
    hints = units.select("document_id").distinct().select("document_id", F.lit(1).alias("hint_index"), F.concat(F.lit("Start of "), "document_id").alias("title"), F.lit(1).alias("page_number"), F.lit(1).alias("level"))
    return headings.font_events(units, hints).select("document_id", "title", "anchor_index", "detection_method")


@query
def dense_text(spark: SparkSession, d: str) -> DataFrame:
    text = retrieval.dense_text(F.lit(""), F.col("title"), F.col("heading_path"), F.col("text"))
    return _chunks(spark, d).select("chunk_id", F.md5(text).alias("digest"))


@query
def unknown_ids(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return validate.unknown_ids(table(spark, d, "labels"), known, "doc_id")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    known = sql.queries()
    return {name: known[name] for name in _QUERIES if name in known}
