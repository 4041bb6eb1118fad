"""The stages from extracted pages to the index, for all documents of a manifest at once.

``extracted`` has ``pages``, ``toc`` and ``tables`` as JSON lines, one folder
for each document; every stage writes Parquet tables below ``processed``.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import chunking, headings, layout, sections
from lectern.sources import readers

SPAN = "array<struct<text:string,font_size:double,is_bold:boolean,is_monospaced:boolean>>"
BLOCK = f"struct<block_index:int,text:string,lines:array<struct<text:string,spans:{SPAN}>>,likely_code_block:boolean,is_repeated_margin:boolean>"
PAGE = f"document_id string, page_number int, blocks array<{BLOCK}>"
TOC = "document_id string, toc_order int, toc_id string, parent_toc_id string, title string, level int, page_number int"
TABLE = "document_id string, page_number int, table_index int, table_id string"
DOCUMENT = (
    "document_id string, title string, author string, publication_year int, document_type string, domain string, source_filename string, source_sha256 string, freshness_warning boolean, "
    "section_detection string, content_start_page int, content_end_page int, maximum_tokens int, overlap_tokens int, minimum_tokens int"
)
HINT = "document_id string, hint_index int, title string, page_number int, level int"


def _chosen(entries: list[dict[str, Any]], documents: list[str] | None) -> list[dict[str, Any]]:
    unknown = sorted(set(documents or ()) - {e["id"] for e in entries})
    if unknown:
        raise readers.ManifestError(f"not in the manifest: {', '.join(unknown)}")
    return [e for e in entries if not documents or e["id"] in documents]


def documents_of(spark: SparkSession, entries: list[dict[str, Any]], maximum: int | None = None, overlap: int | None = None) -> DataFrame:
    """Document records and settings of manifest entries."""
    rows = []
    for e in entries:
        limits = chunking.resolve_profile(e.get("chunk_profile"), e.get("chunking"), maximum, overlap)
        name = str(e.get("path") or "").rsplit("/", 1)[-1]
        rows.append((e["id"], e.get("title") or e["id"], e.get("author"), e.get("publication_year"), e.get("document_type"), e.get("domain"), name, e.get("source_sha256"), bool(e.get("freshness_warning")), e.get("section_detection"), int(e.get("content_start_page") or 1), e.get("content_end_page"), *limits))
    return spark.createDataFrame(rows, DOCUMENT)


def hints_of(spark: SparkSession, entries: list[dict[str, Any]]) -> DataFrame:
    """Manual chapter starts (``chapter_starts``: ``page``, ``title`` and perhaps ``level``) of manifest entries."""
    rows = [(e["id"], k, h.get("title"), int(h.get("page", h.get("page_number"))), int(h.get("level") or 1)) for e in entries for k, h in enumerate(e.get("chapter_starts") or [], 1)]
    return spark.createDataFrame(rows, HINT)


def _extracted(spark: SparkSession, root: str, name: str, schema: str, ids: list[str], required: bool = False) -> DataFrame:
    paths = [f"{root}/{i}/{name}.jsonl" for i in ids]
    there = [p for p in paths if readers.exists(spark, p)]
    if required and len(there) < len(paths):
        raise FileNotFoundError(", ".join(sorted(set(paths) - set(there))))
    return readers.json_lines(spark, there, schema) if there else spark.createDataFrame([], schema)


def detect_sections(spark: SparkSession, manifest: str, extracted: str, processed: str, documents: list[str] | None = None, least: int = sections.LEAST_CHARACTERS) -> DataFrame:
    """Write ``units``, ``sections`` and ``section_reports``; the reports come back."""
    entries = _chosen(readers.manifest(spark, manifest, strict=False), documents)
    ids, records = [e["id"] for e in entries], documents_of(spark, entries)
    pages = _extracted(spark, extracted, "pages", PAGE, ids, required=True)
    toc = _extracted(spark, extracted, "toc", TOC, ids)
    bounds = records.select("document_id", "content_start_page", "content_end_page")
    units = layout.units_of_pages(pages.join(F.broadcast(bounds), "document_id"), F.col("content_start_page"), F.col("content_end_page"))
    units.write.mode("overwrite").partitionBy("document_id").parquet(f"{processed}/units")
    units = spark.read.schema(units.schema).parquet(f"{processed}/units")
    empty = records.join(units, "document_id", "left_anti").orderBy("document_id").first()
    if empty is not None:
        raise ValueError(f"no text in {empty.document_id}")
    modes = headings.detection_modes(records, toc)
    events, anchors = headings.detect(units, toc, modes, hints_of(spark, entries))
    events.write.mode("overwrite").parquet(f"{processed}/events")
    events = spark.read.schema(events.schema).parquet(f"{processed}/events")
    made = sections.build(units, events, least, records, _extracted(spark, extracted, "tables", TABLE, ids))
    made.write.mode("overwrite").partitionBy("document_id").parquet(f"{processed}/sections")
    made = spark.read.schema(made.schema).parquet(f"{processed}/sections")
    report = sections.full_report(made, events, headings.body_font_size(units), modes, headings.toc_warnings(anchors, toc))
    report.write.mode("overwrite").parquet(f"{processed}/section_reports")
    return spark.read.parquet(f"{processed}/section_reports")


def make_chunks(spark: SparkSession, manifest: str, processed: str, documents: list[str] | None = None, maximum: int | None = None, overlap: int | None = None) -> DataFrame:
    """Write ``parents``, ``chunks`` and ``chunk_reports`` of the sections; the reports come back.  Documents of one profile are chunked together."""
    entries = _chosen(readers.manifest(spark, manifest, strict=False), documents)
    units, found = spark.read.parquet(f"{processed}/units"), spark.read.parquet(f"{processed}/sections")
    profiles: dict[tuple[int, int, int], list[dict[str, Any]]] = {}
    for e in entries:
        profiles.setdefault(chunking.resolve_profile(e.get("chunk_profile"), e.get("chunking"), maximum, overlap), []).append(e)
    parts: dict[str, list[DataFrame]] = {"parents": [], "made": [], "reports": []}
    for limits, own in profiles.items():
        most, over, least = limits
        records, mine = documents_of(spark, own, maximum, overlap), F.col("document_id").isin([e["id"] for e in own])
        some, blocks = found.filter(mine), units.filter(mine)
        atoms = chunking.atoms(some.filter(F.coalesce("indexable", F.lit(True))), blocks, most)
        made = chunking.chunk_records(some, atoms, most, over, least, records, distinct=False)
        parts["parents"].append(chunking.parents(some, atoms, records))
        parts["made"].append(made)
        profile = F.struct(F.lit(most).alias("maximum_tokens"), F.lit(over).alias("overlap_tokens"), F.lit(least).alias("minimum_tokens"))
        parts["reports"].append(chunking.full_report(some, blocks, made).withColumn("profile", profile))

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    union(parts["parents"]).write.mode("overwrite").partitionBy("document_id").parquet(f"{processed}/parents")
    chunking.deduplicate(union(parts["made"]), "section_number", "chunk_number").write.mode("overwrite").partitionBy("document_id").parquet(f"{processed}/chunks")
    union(parts["reports"]).write.mode("overwrite").parquet(f"{processed}/chunk_reports")
    return spark.read.parquet(f"{processed}/chunk_reports")
