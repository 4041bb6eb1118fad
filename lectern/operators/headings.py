"""Heading detection: body font, candidates, levels, hierarchy, outline anchoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.layout import half_point

#: Levels that font headings have.
FONT_LEVELS = 3
ACCEPT = 0.64


def body_font_size(units: DataFrame) -> DataFrame:
    """``document_id, body_font_size``: the size of most characters outside code, first seen on ties; 10.0 without any.

    Units with ``font_weights`` count each span by itself, others all their text in one size.
    """
    plain = ~F.col("likely_code_block")
    # code counts without a size, so documents without any other text stay and units are read once
    if "font_weights" in units.columns:
        spans = units.select("document_id", "global_index", F.posexplode_outer(F.when(plain, F.col("font_weights"))).alias("pos", "w"))
        counted = spans.select("document_id", F.col("w.size").alias("size"), F.col("w.n").alias("n"), F.struct("global_index", "pos").alias("at"))
    else:
        counted = units.select("document_id", F.when(plain, half_point(F.col("font_size"))).alias("size"), F.length("text").alias("n"), F.struct("global_index").alias("at"))
    sized = counted.withColumn("size", F.when(F.col("size").between(6, 16), F.col("size")))
    weights = sized.groupBy("document_id", "size").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    first = F.when(F.col("size").isNotNull(), F.struct((-F.col("n")).alias("less"), "at"))
    return weights.groupBy("document_id").agg(F.coalesce(F.min_by("size", first), F.lit(10.0)).alias("body_font_size"))


def with_body(units: DataFrame) -> DataFrame:
    return units.join(body_font_size(units), "document_id")


def _explicit(text: Column) -> Column:
    """Whether a collapsed text begins as a chapter does; only texts with such a first letter are collapsed for it."""
    first = F.left(F.ltrim(text, F.lit(T.SPACES + "\xad")), F.lit(1))
    return F.when(first.isin(*"cpaCPA"), T.collapse_whitespace(text).rlike(T.EXPLICIT_HEADING)).otherwise(False)


def is_candidate(body: Column) -> Column:
    """Whether a unit looks like a heading, given the body font size."""
    text = T.collapse_whitespace(F.col("text"))
    low = T.casefold(text)
    size = F.col("font_size")
    # what most units fail comes first: a title's size, weight or form
    large = (size >= body * 1.15) | ((F.col("bold_ratio") >= 0.65) & (size >= body * 0.95))
    cheap = ~F.col("likely_code_block") & (F.col("line_count") <= 4) & (large | _explicit(F.col("text")))
    fits = F.length(text).between(2, 180) & ~T.is_numeral(F.col("text")) & ~F.contains(low, F.lit("http://")) & ~F.contains(low, F.lit("https://"))
    fits = fits & (T.word_count(text) <= 22) & (~F.endswith(text, F.lit(".")) | F.startswith(low, F.lit("chapter ")))
    # a conjunction would have its common parts made for all rows
    return F.when(cheap, fits).otherwise(False)


def level(body: Column) -> Column:
    """1 to 3, from the title's form, a large numeral just before it on the page, and the font size."""
    order = W.partitionBy("document_id").orderBy("global_index")
    before = lambda c: F.lag(c).over(order)
    size = F.col("font_size")
    # judged where it stands: no text is handed on to the next row
    numeral = F.lag(F.when(size >= body * 3, T.is_numeral(F.col("text")))).over(order)
    after_numeral = F.when(before("page_number") == F.col("page_number"), numeral)
    return F.when(size >= body * 1.45, 1).when(_explicit(F.col("text")), 1).when(after_numeral, 1).when(size >= body * 1.15, 2).otherwise(3)


def font_events(units: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Heading events ``document_id, event_id, title, level, anchor_index, anchor_page, anchor_block_id, anchor_score, detection_method``.

    ``hints`` (``document_id, hint_index, title, page_number, level``) are
    manual chapter starts, which override a font heading at their anchor; the
    last hint wins.
    """
    body = with_body(units)
    leveled = body.withColumn("level", level(F.col("body_font_size"))).withColumn("is_heading", is_candidate(F.col("body_font_size")))
    found = leveled.filter("is_heading").select("document_id", F.lit(None).cast("string").alias("event_id"), T.collapse_whitespace(F.col("text")).alias("title"), "level", F.col("global_index").alias("anchor_index"), F.col("page_number").alias("anchor_page"), F.col("source_block_id").alias("anchor_block_id"), F.lit(1.0).alias("anchor_score"), F.lit("font-heading").alias("detection_method"), F.lit(0).alias("rank"))
    if hints is not None:
        manual = manual_anchors(leveled, hints).select("document_id", F.format_string("manual-%04d", F.col("hint_index")).alias("event_id"), T.collapse_whitespace(F.col("title")).alias("title"), "level", "anchor_index", "anchor_page", "anchor_block_id", F.lit(1.0).alias("anchor_score"), F.lit("manual-chapter-anchor").alias("detection_method"), F.col("hint_index").alias("rank"))
        at = W.partitionBy("document_id", "anchor_index").orderBy(F.desc("rank"))
        found = found.unionByName(manual).withColumn("k", F.row_number().over(at)).filter("k = 1").drop("k")
    number = F.row_number().over(W.partitionBy("document_id").orderBy("anchor_index"))
    return found.withColumn("event_id", F.coalesce("event_id", F.format_string("font-%04d", number))).drop("rank")


def manual_anchors(leveled: DataFrame, hints: DataFrame) -> DataFrame:
    """The unit of each hint's page: the largest, boldest, earliest heading, else the first that is no numeral."""
    named = hints.select("document_id", "hint_index", "title", F.col("level").alias("hint_level"), "page_number")
    pick = F.struct("is_heading", F.when(F.col("is_heading"), F.col("font_size")).alias("s"), F.when(F.col("is_heading"), F.col("bold_ratio")).alias("b"), (-F.col("block_index")).alias("o"))
    own = leveled.filter(~T.is_numeral(F.col("text"))).drop("level").join(named, ["document_id", "page_number"])
    best = own.groupBy("document_id", "hint_index").agg(F.max_by(F.struct("title", F.col("hint_level").alias("level"), F.col("global_index").alias("anchor_index"), F.col("page_number").alias("anchor_page"), F.col("source_block_id").alias("anchor_block_id")), pick).alias("a"))
    return best.select("document_id", "hint_index", "a.*")


def deepest_level(events: DataFrame) -> int:
    """The greatest level of any event, 1 without events."""
    return events.agg(F.coalesce(F.max("level"), F.lit(1)).alias("n")).first().n


def with_parents(events: DataFrame, deepest: int | None = None) -> DataFrame:
    """``parent_event_id``: the latest earlier event at a lower level, if it is exactly one level up.

    One window expression for each level up to ``deepest``, which is looked up
    in the events where the caller does not know it.
    """
    past = W.partitionBy("document_id").orderBy("anchor_index").rowsBetween(W.unboundedPreceding, -1)
    parent = F.lit(None).cast("string")
    for k in range(1, deepest_level(events) if deepest is None else deepest):
        above = F.last(F.when(F.col("level") <= k, F.struct("level", "event_id")), ignorenulls=True).over(past)
        parent = F.when((F.col("level") == k + 1) & (above["level"] == k), above["event_id"]).otherwise(parent)
    return events.withColumn("parent_event_id", parent)


def with_level_paths(events: DataFrame, deepest: int | None = None) -> DataFrame:
    """``heading_path`` where parents come from levels, by the same window as ``with_parents``.

    Nothing between an event and its parent is at the parent's level or above,
    so the ancestor of each level is the latest earlier event at that level,
    as long as no level is skipped.
    """
    past = W.partitionBy("document_id").orderBy("anchor_index").rowsBetween(W.unboundedPreceding, -1)
    latest = lambda k: F.last(F.when(F.col("level") <= k, F.struct("level", "title")), ignorenulls=True).over(past).alias(str(k))
    above = [F.struct(F.coalesce(latest(k)["level"], F.lit(0)).alias("level"), latest(k)["title"].alias("title")) for k in range(1, deepest_level(events) if deepest is None else deepest)]
    rows = events.withColumn("_above", F.array(*above) if above else F.array().cast("array<struct<level:int,title:string>>"))
    start = F.struct(F.array("title").alias("path"), F.lit(True).alias("on"))
    up = F.when(F.col("level") > 1, F.reverse(F.slice("_above", F.lit(1), F.col("level") - 1))).otherwise(F.slice("_above", 1, 0))

    def climb(acc: Column, a: Column) -> Column:
        on = acc["on"] & (a["level"] == F.col("level") - F.size(acc["path"]))
        return F.struct(F.when(on, F.concat(F.array(a["title"]), acc["path"])).otherwise(acc["path"]).alias("path"), on.alias("on"))

    return rows.withColumn("heading_path", F.aggregate(up, start, climb, lambda acc: acc["path"])).drop("_above")


def heading_paths(events: DataFrame, deepest: int | None = None) -> DataFrame:
    """``document_id, event_id, heading_path``: titles from the top to the event.

    A parent is one level up, so a chain has at most as many steps as there
    are levels; each is a join on (document, event), and cycles end there as well.
    A parent that is no event ends the path.
    """
    parents = events.select("document_id", F.col("event_id").alias("at"), F.col("title").alias("up_title"), F.col("parent_event_id").alias("up"))
    path = events.select("document_id", "event_id", F.array("title").alias("heading_path"), F.col("parent_event_id").alias("at"))
    for _ in range((deepest_level(events) if deepest is None else deepest) - 1):
        path = path.join(parents, ["document_id", "at"], "left").select("document_id", "event_id", F.when(F.col("up_title").isNull(), F.col("heading_path")).otherwise(F.concat(F.array("up_title"), F.col("heading_path"))).alias("heading_path"), F.col("up").alias("at"))
    return path.select("document_id", "event_id", "heading_path")


ANCHORS = "document_id string, toc_id string, parent_toc_id string, title string, level int, anchor_index int, anchor_page int, anchor_block_id string, anchor_score double, detection_method string"


def toc_anchors(toc: DataFrame, units: DataFrame) -> DataFrame:
    """Outline entries (``document_id, toc_order, toc_id, parent_toc_id, title, page_number, level``) at their units.

    Similarities are computed set-wise for the pages within reach of each
    entry; the choice, which moves forward through the document entry by entry,
    is a fold over those short candidate lists.
    Unresolved entries come out with null anchors.
    """
    marked = with_body(units)
    marked = marked.withColumn("heading", is_candidate(F.col("body_font_size"))).select("document_id", "global_index", F.col("page_number").alias("unit_page"), "source_block_id", "text", "heading")
    near = toc.withColumn("variants", T.title_variants(F.col("title"))).withColumn("offset", F.explode(F.array(*map(F.lit, (-1, 0, 1, 2)))))
    near = near.withColumn("unit_page", F.col("page_number") + F.col("offset"))
    pairs = near.join(marked, ["document_id", "unit_page"], "left")
    # pages two ahead serve the fallback only: their texts need no comparison, which a condition on the function would not spare
    score = T.likely_similarity(F.col("variants"), F.col("text"))
    scored = pairs.filter("offset < 2").withColumn("score", F.least(F.lit(1.0), score + F.when(F.col("heading"), 0.03).otherwise(0.0)) - F.abs("offset") * 0.04)
    pairs = scored.unionByName(pairs.filter("offset = 2").withColumn("score", F.lit(None).cast("double")))
    per = pairs.groupBy("document_id", "toc_order", "toc_id", "parent_toc_id", "title", "level").agg(F.collect_list(F.when(F.col("global_index").isNotNull(), F.struct("offset", "global_index", "unit_page", "source_block_id", "score", "heading"))).alias("near"))

    entries = per.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("toc_order", "toc_id", "parent_toc_id", "title", "level", "near"))).alias("entries"))
    return anchored(entries)


def _placed(u: Column) -> Column:
    return F.struct(*(u[c].alias(c) for c in ("global_index", "unit_page", "source_block_id")))


def _choice(e: Column, least: Column) -> Column:
    """``found, worth, how`` of an entry among its units from ``least`` on."""
    open_ = F.filter(e["near"], lambda u: u["global_index"] >= least)
    scored = F.filter(open_, lambda u: (u["offset"] < 2) & (u["score"] > 0))
    order = lambda u: F.struct((-u["score"]).alias("less"), F.when(u["offset"] < 0, 2).otherwise(u["offset"]).alias("far"), *(u[c].alias(c) for c in ("global_index", "unit_page", "source_block_id")))
    best = F.array_min(F.transform(scored, order))
    ahead = F.filter(open_, lambda u: u["offset"] >= 0)
    first, head = F.array_min(F.transform(ahead, _placed)), F.array_min(F.transform(F.filter(ahead, lambda u: u["heading"]), _placed))

    def of(x: Column) -> Column:
        good = F.coalesce(-x["best"]["less"] >= ACCEPT, F.lit(False))
        found = F.when(good, _placed(x["best"])).otherwise(F.coalesce(x["head"], x["first"]))
        how = F.when(good, "toc-text-anchor").when(x["head"].isNotNull(), "toc-heading-fallback").when(x["first"].isNotNull(), "toc-page-fallback").otherwise("unresolved")
        return F.struct(found.alias("found"), F.when(good, F.bround(-x["best"]["less"], 4)).otherwise(0.0).alias("worth"), how.alias("how"))

    return T.let(F.struct(best.alias("best"), first.alias("first"), head.alias("head")), of)


def anchored(entries: DataFrame) -> DataFrame:
    """Anchors of each document's ``entries`` in order, each behind the last that was found.

    An entry has its outline fields and ``near``, the units within reach:
    ``offset`` of their page, place, ``score`` and whether they are a
    ``heading``.  The best score from ``ACCEPT`` on decides, the own page before
    the next and the last one before equal scores, then the earlier unit;
    otherwise the first heading, or unit, from the entry's page on.
    """
    fields = [f.split() for f in ANCHORS.split(", ")[1:]]
    kind = f"struct<{','.join(f'{name}:{kind}' for name, kind in fields)}>"

    def step(acc: Column, e: Column) -> Column:
        def of(x: Column) -> Column:
            place = [x["found"][c] for c in ("global_index", "unit_page", "source_block_id")]
            values = (e["toc_id"], e["parent_toc_id"], e["title"], e["level"], *place, x["worth"], x["how"])
            row = F.struct(*(v.cast(k).alias(name) for v, (name, k) in zip(values, fields)))
            return F.struct(F.coalesce(x["found"]["global_index"].cast("int") + 1, acc["least"]).alias("least"), F.concat(acc["rows"], F.array(row)).alias("rows"))

        return T.let(_choice(e, acc["least"]), of)

    start = F.struct(F.lit(0).alias("least"), F.array().cast(f"array<{kind}>").alias("rows"))
    return entries.select("document_id", F.explode(F.aggregate("entries", start, step)["rows"]).alias("a")).select("document_id", "a.*")


def toc_parents(toc: DataFrame, deepest: int | None = None) -> DataFrame:
    """Outline rows (``document_id, toc_order, title, level, page_number``) with ids and parents by level; ``deepest`` as for ``with_parents``."""
    events = toc.withColumn("event_id", F.format_string("toc-%04d", F.col("toc_order"))).withColumn("anchor_index", F.col("toc_order"))
    # an outline's rows are few beside the text's
    return with_parents(events, deepest).withColumnRenamed("event_id", "toc_id").withColumnRenamed("parent_event_id", "parent_toc_id").drop("anchor_index")


def toc_events(anchors: DataFrame) -> DataFrame:
    """Heading events of the outline entries that were found; their parents are the outline's."""
    found = anchors.filter("anchor_index IS NOT NULL")
    return found.select(
        "document_id",
        F.col("toc_id").alias("event_id"),
        F.col("parent_toc_id").alias("parent_event_id"),
        T.collapse_whitespace(F.col("title")).alias("title"),
        "level",
        "anchor_index",
        "anchor_page",
        "anchor_block_id",
        "anchor_score",
        "detection_method",
    )


def toc_warnings(anchors: DataFrame, toc: DataFrame) -> DataFrame:
    """``document_id, warnings``: one message for each outline entry that was not found, in outline order."""
    lost = anchors.filter("anchor_index IS NULL").select("document_id", "toc_id").join(toc.select("document_id", "toc_id", "toc_order", "title", "page_number"), ["document_id", "toc_id"])
    said = F.format_string("Could not resolve TOC entry '%s' on page %d.", F.col("title"), F.col("page_number"))
    return lost.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("toc_order", said.alias("said")))), lambda x: x["said"]).alias("warnings"))


MODES = ("auto", "toc", "font")


def detection_modes(documents: DataFrame, toc: DataFrame) -> DataFrame:
    """``document_id, detection_mode`` (toc or font) from ``section_detection``; any other value, null included, means toc where there is an outline."""
    outlined = toc.select("document_id").distinct().withColumn("_toc", F.lit(True))
    asked = F.col("section_detection")
    mode = F.when(asked.isin("toc", "font"), asked).when(F.col("_toc"), "toc").otherwise("font")
    return documents.select("document_id", "section_detection").join(outlined, "document_id", "left").select("document_id", mode.alias("detection_mode"))


def detect(units: DataFrame, toc: DataFrame, modes: DataFrame, hints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Heading events of all documents with ``heading_path``, each by its mode, and the anchors of all outline entries.

    ``toc`` has ``document_id, toc_order, toc_id, parent_toc_id, title, level, page_number``.
    """
    of = lambda rows, mode: rows.join(modes.filter(F.col("detection_mode") == mode).select("document_id"), "document_id", "left_semi")
    anchors = toc_anchors(of(toc, "toc"), of(units, "toc"))
    named = toc_events(anchors)
    by_toc = named.join(heading_paths(named, deepest_level(toc)), ["document_id", "event_id"])
    by_font = with_level_paths(with_parents(font_events(of(units, "font"), hints), FONT_LEVELS), FONT_LEVELS)
    return by_font.unionByName(by_toc), anchors
