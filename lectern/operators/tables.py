"""Tables of pages, from where their words stand: bands of rows, gaps between columns, cells and markdown.

``spans`` are ``document_id, page_number, x0, y0, x1, y1, text``.  Spans that
overlap in height are a band.  A band with a gap of at least ``gap`` between
spans has several cells; two or more such bands, one closely below the other,
are a table.  Its columns are what gaps of that width cut all its spans into.

All of it is windows within a page.  Spans without text or without a proper box
take no part and are told by ``failures``; repeated spans count once.  Spans
of equal places are ordered by text.  No spans, no tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T

#: Points between the cells of a row at least, and heights of a row between it and the next at most.
GAP, ROW_GAP = 12.0, 1.5
PAGE = ("document_id", "page_number")


def _boxed() -> Column:
    return F.coalesce((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")), F.lit(False))


def _stretches(rows: DataFrame, name: str, start: str, end: str, group: tuple[str, ...], order: tuple[str, ...], gap: float) -> DataFrame:
    """Rows with the number of their stretch (from 1): one begins ``gap`` or more behind all that came before in the group."""
    sorted_ = W.partitionBy(*group).orderBy(*order)
    before = F.max(end).over(sorted_.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.coalesce(F.col(start) - before >= gap, F.lit(True))
    counted = F.sum(F.col("_new").cast("int")).over(sorted_.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("_new", fresh).withColumn(name, counted.cast("int")).drop("_new")


def _line(cells: Column) -> Column:
    escaped = F.transform(cells, lambda c: F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), r"\s*\n\s*", "<br>"))
    return F.concat(F.lit("|"), F.array_join(escaped, "|"), F.lit("|"))


def markdown(cells: Column) -> Column:
    """Rows of cells as a markdown table, the first row as its head."""
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.get(cells, F.lit(0)))))
    lines = F.transform(cells, _line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n")


def tables(spans: DataFrame, gap: float = GAP, row_gap: float = ROW_GAP) -> DataFrame:
    """``table_id, document_id, page_number, table_index, bbox, row_count, column_count, cells, markdown, error``.

    Cells without text are empty strings.  Where a table's spans leave no column
    free from top to bottom, it has one column, no markdown and an error.
    """
    # all that follows is within a page: spans that lie by page already are not dealt again, and repeated ones are found beside each other
    same = W.partitionBy(*PAGE).orderBy("y0", "x0", "text", "x1", "y1")
    words = spans.filter(_boxed() & (T.strip(F.col("text")) != "")).select(*PAGE, "x0", "y0", "x1", "y1", T.strip(F.col("text")).alias("text"))
    fresh = F.lag("text").over(same).isNull()
    for c in ("y0", "x0", "text", "x1", "y1"):
        fresh = fresh | (F.lag(c).over(same) != F.col(c))
    words = words.withColumn("_fresh", fresh).filter("_fresh").drop("_fresh")
    banded = _stretches(words, "band", "y0", "y1", PAGE, ("y0", "x0", "text"), 0.0)
    celled = _stretches(banded, "cell", "x0", "x1", (*PAGE, "band"), ("x0", "y0", "text"), gap)
    # a band keeps its spans with it, so that those of tables need no join
    span = F.struct("x0", "y0", "x1", "y1", "text")
    bands = celled.groupBy(*PAGE, "band").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.max("cell").alias("n"), F.collect_list(span).alias("spans"))
    bands = bands.withColumn("spans", F.when(F.col("n") > 1, F.col("spans")))
    down = W.partitionBy(*PAGE).orderBy("band")
    close = (F.lag("n").over(down) > 1) & (F.col("top") - F.lag("bottom").over(down) <= row_gap * (F.lag("bottom").over(down) - F.lag("top").over(down)))
    joined = bands.withColumn("first", ~F.coalesce(close & (F.col("n") > 1), F.lit(False)))
    runs = joined.withColumn("run", F.sum(F.col("first").cast("int")).over(down.rowsBetween(W.unboundedPreceding, W.currentRow)))
    whole = W.partitionBy(*PAGE, "run")
    kept = runs.filter("n > 1").withColumn("rows", F.count("*").over(whole)).filter("rows > 1").withColumn("table_index", F.dense_rank().over(W.partitionBy(*PAGE).orderBy("run")))
    own = kept.select(*PAGE, "band", "table_index", F.explode("spans").alias("s")).select(*PAGE, "band", "table_index", "s.*")
    key = (*PAGE, "table_index")
    columned = _stretches(own, "column", "x0", "x1", key, ("x0", "y0", "band", "text"), gap)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "y0", "text"))), lambda s: s["text"]), " ")
    sides = (F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    cells = columned.groupBy(*key, "band", "column").agg(text.alias("text"), *sides)
    rows = cells.groupBy(*key, "band").agg(F.collect_list(F.struct("column", "text")).alias("cells"), F.max("column").alias("last"), *sides)
    grids = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("band", "cells"))).alias("r"), F.max("last").cast("int").alias("column_count"), *sides)
    filled = F.transform("r", lambda row: F.transform(F.sequence(F.lit(1), F.col("column_count")), lambda k: F.coalesce(F.try_element_at(F.map_from_entries(row["cells"]), k), F.lit(""))))
    page, index = F.col("page_number"), F.col("table_index")
    whole_page = F.format_string("%s/page-%04d/table-%03d", F.col("document_id"), page, index)
    single = F.col("column_count") < 2
    made = grids.withColumn("grid", filled)
    return made.select(
        whole_page.alias("table_id"),
        *key,
        T.rounded_box(F.array("x0", "y0", "x1", "y1")).alias("bbox"),
        F.size("grid").alias("row_count"),
        "column_count",
        F.col("grid").alias("cells"),
        F.when(~single, markdown(F.col("grid"))).alias("markdown"),
        F.when(single, F.format_string("Table Markdown conversion failed on page %d, table %d: no column is free from top to bottom", page, index)).alias("error"),
    )


def failures(spans: DataFrame) -> DataFrame:
    """``document_id, page_number, error`` of the pages with spans of text that have no proper box."""
    lost = spans.filter(~_boxed() & (T.strip(F.coalesce("text", F.lit(""))) != "")).groupBy(*PAGE).agg(F.count("*").alias("n"))
    return lost.select(*PAGE, F.format_string("Table detection failed on page %d: %d spans without a box", F.col("page_number"), F.col("n")).alias("error"))


def spans_of(pages: DataFrame) -> DataFrame:
    """The spans of nested pages ``document_id, page_number, blocks``, whose lines have spans with a ``bbox`` of four numbers."""
    line = pages.select(*PAGE, F.explode("blocks").alias("b")).select(*PAGE, F.explode("b.lines").alias("l"))
    span = line.select(*PAGE, F.explode("l.spans").alias("s"))
    side = lambda k, name: F.get(F.col("s.bbox"), F.lit(k)).cast("double").alias(name)
    return span.select(*PAGE, side(0, "x0"), side(1, "y0"), side(2, "x1"), side(3, "y1"), F.col("s.text").alias("text"))
