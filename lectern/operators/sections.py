"""Sections between heading events: text, spans, flags, tables, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.headings import ACCEPT, heading_paths
from lectern.sources.sinks import stage

SCHEMA_VERSION = "1.0"
LEAST_CHARACTERS = 80


def numbered(events: DataFrame) -> DataFrame:
    """Events with ``section_number`` and ``section_id``."""
    order = W.partitionBy("document_id").orderBy("anchor_index")
    rows = events.withColumn("section_number", F.row_number().over(order))
    return rows.withColumn("section_id", F.concat("document_id", F.lit("/"), F.format_string("%04d", F.col("section_number")), F.lit("-"), T.slugify(F.col("title"))))


def assign(units: DataFrame, events: DataFrame, together: bool = False) -> DataFrame:
    """Units with the event they belong to: the latest anchor at or before them.

    A forward fill instead of an interval join; units before the first anchor
    belong to no section and are dropped.  ``together`` says that both lie by
    document already, so that a join deals nothing, where a union would.
    """
    if together:
        places = events.select("document_id", F.col("anchor_index").alias("global_index"), F.col("event_id").alias("own"))
        upto = W.partitionBy("document_id").orderBy("global_index")
        return units.join(places, ["document_id", "global_index"], "left").withColumn("event_id", F.last("own", ignorenulls=True).over(upto)).filter("event_id IS NOT NULL").drop("own").select(*units.columns, "event_id")
    # anchors between the units in one window: a join by place would deal all texts once more
    anchors = events.select("document_id", F.col("anchor_index").cast(units.schema["global_index"].dataType).alias("global_index"), F.col("event_id").alias("own"), F.lit(False).alias("_unit"))
    order = W.partitionBy("document_id").orderBy("global_index", "_unit")
    rows = units.withColumn("_unit", F.lit(True)).unionByName(anchors, allowMissingColumns=True)
    return rows.withColumn("event_id", F.last("own", ignorenulls=True).over(order)).filter("_unit AND event_id IS NOT NULL").drop("own", "_unit")


def table_ids(spans: DataFrame, tables: DataFrame) -> DataFrame:
    """``document_id, section_id, table_ids``: tables on the pages of each section (``page_start``..``page_end``).

    Each span is unfolded into its pages, so the range condition is an equi-join.
    """
    pages = spans.select("document_id", "section_id", F.explode(F.sequence("page_start", "page_end")).alias("page_number"))
    found = pages.join(tables.select("document_id", "page_number", "table_index", "table_id"), ["document_id", "page_number"])
    order = F.array_sort(F.collect_list(F.struct("page_number", "table_index", "table_id")))
    return found.groupBy("document_id", "section_id").agg(F.array_distinct(F.transform(order, lambda x: x["table_id"])).alias("table_ids"))


def build(units: DataFrame, events: DataFrame, least: int = LEAST_CHARACTERS, documents: DataFrame | None = None, tables: DataFrame | None = None, together: bool = False) -> DataFrame:
    """Section records from events (with ``parent_event_id``, and ``heading_path`` if known) and units.

    ``documents`` (``document_id, title, author, publication_year,
    source_filename, source_sha256``) gives source and citation; without it the
    id stands for the title.  ``tables`` (``document_id, page_number,
    table_index, table_id``) gives ``table_ids``, which are empty otherwise.
    A parent event that is missing leaves ``parent_section_id`` null.
    ``together`` is as for ``assign``.
    """
    # read twice; where they lie by document they are written once, with their slugs
    named = stage(numbered(events), "document_id") if together else numbered(events)
    ids = named.select("document_id", F.col("event_id").alias("parent_event_id"), F.col("section_id").alias("parent_section_id"))
    head = named.join(ids, ["document_id", "parent_event_id"], "left")
    if "heading_path" not in events.columns:
        head = head.join(heading_paths(events), ["document_id", "event_id"])
    order = F.array_sort(F.collect_list(F.struct("global_index", "text", "source_block_id")))
    body = assign(units, events, together).groupBy("document_id", "event_id").agg(
        order.alias("parts"), F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.bool_or("likely_code_block").alias("contains_code")
    )
    text = T.strip(F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n"))
    rows = head.join(body.withColumn("text", text), ["document_id", "event_id"])
    none = lambda kind: F.lit(None).cast(kind)
    if documents is None:
        rows = rows.withColumns({"document_title": F.col("document_id"), "author": none("string"), "publication_year": none("int"), "source_filename": none("string"), "source_sha256": none("string")})
    else:
        rows = rows.join(documents.select("document_id", F.col("title").alias("document_title"), "author", "publication_year", "source_filename", "source_sha256"), "document_id", "left")
    if tables is None:
        rows = rows.withColumn("table_ids", F.array().cast("array<string>"))
    else:
        rows = rows.join(table_ids(rows, tables), ["document_id", "section_id"], "left").withColumn("table_ids", F.coalesce("table_ids", F.array().cast("array<string>")))
    short = F.length("text") < least
    flags = F.array_compact(F.array(F.when(F.endswith("detection_method", F.lit("fallback")), "fallback-heading-anchor"), F.when(short, "short-section"), F.when(F.col("anchor_score") < ACCEPT, "low-anchor-confidence")))
    return rows.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "section_id",
        "document_id",
        "parent_section_id",
        "section_number",
        "title",
        "heading_path",
        "level",
        "page_start",
        "page_end",
        "text",
        F.length("text").cast("long").alias("character_count"),
        T.word_count(F.col("text")).alias("word_count"),
        F.transform("parts", lambda p: p["source_block_id"]).alias("source_block_ids"),
        "table_ids",
        "contains_code",
        (T.is_indexable_title(F.col("title")) & ~short).alias("indexable"),
        F.struct(F.col("detection_method").alias("method"), "anchor_page", "anchor_block_id", "anchor_score").alias("detection"),
        F.struct(F.col("document_title").alias("title"), "author", "publication_year", "source_filename", "source_sha256").alias("source"),
        F.struct("document_title", F.col("title").alias("section_title"), "page_start", "page_end").alias("citation"),
        flags.alias("quality_flags"),
    )


def full_report(sections: DataFrame, events: DataFrame, body: DataFrame, modes: DataFrame, warnings: DataFrame) -> DataFrame:
    """``report`` with ``schema_version, detection_mode, body_font_size, heading_event_count, warnings``, for every document in ``modes``."""
    counted = events.groupBy("document_id").agg(F.count("*").alias("heading_event_count"))
    rows = modes.join(body, "document_id", "left").join(counted, "document_id", "left").join(report(sections), "document_id", "left").join(warnings, "document_id", "left")
    zero = [c for c in rows.columns if c.endswith("_count")]
    return rows.fillna(0, zero).withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>"))).withColumn("schema_version", F.lit(SCHEMA_VERSION))


def report(sections: DataFrame) -> DataFrame:
    """Counts per document."""
    flagged = lambda f: F.count_if(F.array_contains("quality_flags", f))
    return sections.groupBy("document_id").agg(
        F.count("*").alias("section_count"),
        F.count_if("indexable").alias("indexable_section_count"),
        F.count_if(~F.col("indexable")).alias("non_indexable_section_count"),
        F.count_if("contains_code").alias("sections_with_code_count"),
        flagged("short-section").alias("short_section_count"),
        flagged("fallback-heading-anchor").alias("fallback_anchor_count"),
        flagged("low-anchor-confidence").alias("low_confidence_anchor_count"),
    )
