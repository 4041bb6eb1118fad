"""The driver's tables in the engine's data model.

``documents`` become laid-out blocks: line ``k`` is the body block at position
``2k + 1``, and every fifth line also gives a heading block (its first words)
just before it.  Twenty positions make a page; font sizes, weights and
coordinates follow from the position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T

LINES_PER_PAGE, PAGE_HEIGHT = 20, 792.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_id(c: str = "doc_id"):
    return F.format_string("doc-%06d", F.col(c))


def records(documents: DataFrame) -> DataFrame:
    """Document records: ``document_id, title, author, publication_year, document_type, domain, source_filename, source_sha256, freshness_warning``."""
    n = F.col("doc_id")
    return documents.select(
        document_id().alias("document_id"),
        F.concat(F.lit("Document "), n.cast("string")).alias("title"),
        F.col("lang").alias("author"),
        (2000 + n % 25).cast("int").alias("publication_year"),
        F.when(n % 3 == 0, "").otherwise("book").alias("document_type"),
        F.col("source").alias("domain"),
        F.format_string("doc-%06d.txt", n).alias("source_filename"),
        F.sha2("text", 256).alias("source_sha256"),
        (n % 7 == 0).alias("freshness_warning"),
    )


def page_tables(blocks: DataFrame) -> DataFrame:
    """One table on each page: ``document_id, page_number, table_index, table_id``."""
    pages = blocks.select("document_id", "page_number").distinct()
    return pages.withColumn("table_index", F.lit(1)).withColumn("table_id", F.concat("document_id", F.format_string("/page-%04d/table-001", F.col("page_number"))))


def block_rows(documents: DataFrame, deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``document_id, pos, page_number, block_index, source_block_id, text, font_size, bold_ratio, monospaced_ratio, line_count, y0, y1``.

    ``deal`` places whole documents, before they become many rows.
    """
    block = lambda pos, text, size, head: F.struct(pos.alias("pos"), text.alias("text"), size.alias("font_size"), F.lit(head).alias("head"))

    def of_line(x, k):
        body = block(2 * k + 1, T.strip(x), F.lit(10.0), False)
        size = F.when(k % 15 == 0, 16.0).when(k % 2 == 0, 12.0).otherwise(10.5)
        head = block(2 * k, F.regexp_replace(F.left(T.strip(x), F.lit(60)), r"(?U)[.\s]+\z", ""), size, True)
        return F.when(k % 5 == 0, F.array(head, body)).otherwise(F.array(body))

    named = documents.select(document_id().alias("document_id"), "text")
    lines = (deal(named) if deal else named).select("document_id", F.explode(F.flatten(F.transform(F.split("text", "\n"), of_line))).alias("b")).select("document_id", "b.*")
    pos = F.col("pos")
    page, index = (F.floor(pos / LINES_PER_PAGE) + 1).cast("int"), (pos % LINES_PER_PAGE).cast("int")
    rows = lines.select(
        "document_id",
        "pos",
        page.alias("page_number"),
        index.alias("block_index"),
        F.format_string("page-%04d/block-%03d", page, index).alias("source_block_id"),
        "text",
        "font_size",
        F.when(F.col("head") & (pos % 4 != 2), 1.0).otherwise(0.0).alias("bold_ratio"),
        F.when(pos % 11 == 3, 0.6).otherwise(0.0).alias("monospaced_ratio"),
        F.lit(1).alias("line_count"),
        (PAGE_HEIGHT * index / LINES_PER_PAGE).alias("y0"),
        (PAGE_HEIGHT * (index + 1) / LINES_PER_PAGE).alias("y1"),
    )
    return rows.filter(F.col("text") != "")


def book_pages(documents: DataFrame) -> DataFrame:
    """Documents of one source as the pages of one book: ``document_id, page_number, height, block_index, block_count, text, y0, y1``."""
    lines = documents.select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"), F.split("text", "\n").alias("lines"))
    n = F.size("lines")
    rows = lines.select("document_id", "page_number", F.lit(PAGE_HEIGHT).alias("height"), n.alias("block_count"), F.posexplode("lines").alias("block_index", "text"))
    first, last = F.col("block_index") == 0, F.col("block_index") == F.col("block_count") - 1
    y0 = F.when(first, 30.0).when(last, 720.0).otherwise(300.0)
    return rows.withColumn("y0", y0).withColumn("y1", F.col("y0") + 30.0)


def page_spans(documents: DataFrame, deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Nested pages with boxes: each document a page, each line a block; of every seven lines, three have their words 120 points apart.

    ``document_id, page_number, blocks`` with lines and spans; a letter is five
    points wide, a line eleven high and fourteen below the last.  ``deal`` places
    whole documents, before they become many spans.
    """

    def of_line(x, k):
        words = F.filter(F.split(T.strip(x), r"\s+"), lambda w: w != "")
        top = 72.0 + 14.0 * k
        box = lambda left, text: F.array(left, top, left + 5.0 * F.length(text), top + 11.0)
        span = lambda left, text: F.struct(text.alias("text"), box(left, text).alias("bbox"))
        apart = F.transform(words, lambda w, j: span(60.0 + 120.0 * (j % 4), w))
        one = F.filter(F.array(span(F.lit(60.0), F.array_join(words, " "))), lambda s: s["text"] != "")
        line = F.struct(T.strip(x).alias("text"), F.when((k % 7).isin(2, 3, 4), apart).otherwise(one).alias("spans"))
        return F.struct(k.alias("block_index"), F.array(line).alias("lines"))

    named = documents.filter("text IS NOT NULL").select(document_id().alias("document_id"), "text")
    return (deal(named) if deal else named).select("document_id", F.lit(1).alias("page_number"), F.transform(F.split("text", "\n"), of_line).alias("blocks"))


#: Lines of commands that the text tables lack, as (line number, text).
COMMAND_LINES = (
    "sudo nmap -sV 10.0.0.1",
    "GET /index.html HTTP/1.1",
    "export PATH=/usr/bin",
    "select name from users",
    "$ ls -la",
    "PS C:\\Users> dir",
    "cat /etc/passwd | grep root",
    "echo hi > out.txt",
    "https://example.org/path",
    "/usr/local/bin/tool",
    '"key": "value"',
    "192.168.0.0/24",
    "pip install requests",
    "docker run image",
    "git clone repository",
    "-v, --verbose output",
    "main(argument)",
    "An ordinary sentence about nothing.",
    "Section 4 describes results",
)


def command_lines(documents: DataFrame) -> DataFrame:
    """``document_id, pos, text, monospaced_ratio``: the documents' lines and ``COMMAND_LINES``."""
    spark = documents.sparkSession
    own = block_rows(documents).select("document_id", "pos", "text", "monospaced_ratio")
    extra = spark.createDataFrame([("commands", k, t, 0.3 if k % 2 else 0.0) for k, t in enumerate(COMMAND_LINES)], own.schema)
    return own.unionByName(extra)
