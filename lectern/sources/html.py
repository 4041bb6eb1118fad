"""Web pages as text blocks: the substitute for a PDF's blocks where the source is HTML.

Head, scripts, styles, navigation, footers and comments are left out; block
elements cut the text, headings keep their level, other tags vanish.  Blank
blocks are dropped and the rest numbered from 0.  A null page has no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

LEFT_OUT = "(?is)" + "|".join(rf"<{t}\b.*?</{t}\s*>" for t in ("head", "script", "style", "nav", "footer")) + "|<!--.*?-->"
HEADING = r"(?i)<h([1-6])\b[^>]*>"
CUT = r"(?i)</?(?:p|li|ul|ol|pre|br|hr|div|section|article|main|blockquote|table|tr|td|th|dl|dt|dd|h[1-6])\b[^>]*>"
TAG = r"(?s)<[^>]*>"
#: Character references, the ampersand last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
_MARK, _LEVEL = "\x01", "\x02"


def unescaped(c: Column) -> Column:
    for name, sign in REFERENCES:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, block_index, level, text``; ``level`` is 1 to 6 for headings and null for other blocks."""
    body = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), LEFT_OUT, "")
    marked = F.regexp_replace(F.regexp_replace(body, HEADING, f"{_MARK}$1{_LEVEL}"), CUT, _MARK)

    def block(piece: Column) -> Column:
        level = F.when(F.substring(piece, 2, 1) == _LEVEL, F.substring(piece, 1, 1).cast("int"))
        inside = F.when(level.isNotNull(), F.substring(piece, F.lit(3), F.length(piece))).otherwise(piece)
        return F.struct(level.alias("level"), T.squeeze(unescaped(F.regexp_replace(inside, TAG, ""))).alias("text"))

    found = F.filter(F.transform(F.split(marked, _MARK), block), lambda b: b["text"] != "")
    return pages.select(key, F.posexplode(found).alias("block_index", "b")).select(key, "block_index", "b.*")


def outline(found: DataFrame, key: str = "page_id") -> DataFrame:
    """The headings of ``blocks`` as outline rows ``document_id, toc_order, title, level, page_number``, one page for each document."""
    from pyspark.sql import Window as W

    order = F.row_number().over(W.partitionBy(key).orderBy("block_index"))
    return found.filter("level IS NOT NULL").select(F.col(key).cast("string").alias("document_id"), order.alias("toc_order"), F.col("text").alias("title"), "level", F.lit(1).alias("page_number"))
