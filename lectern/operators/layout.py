"""Layout operators: flattening, spans and lines, code blocks, repeated margins, page reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T

#: What a command line starts with.
COMMAND_PREFIXES = (
    "$ ", "# ", "> ", "% ", "~$ ", "~# ", "PS> ", "PS C:", "C:\\", "C:/", "sudo ",
    "python ", "python3 ", "python2 ", "pip ", "pip3 ", "ruby ", "perl ", "node ", "php ", "bash ", "sh ", "zsh ", "powershell ", "pwsh ",
    "curl ", "wget ", "nc ", "ncat ", "netcat ", "ssh ", "scp ", "sftp ", "telnet ", "ftp ", "ping ", "traceroute ", "tracert ", "dig ", "nslookup ", "host ",
    "nmap ", "masscan ", "sqlmap ", "nikto ", "ffuf ", "gobuster ", "dirsearch ", "wfuzz ", "hydra ", "john ", "hashcat ", "metasploit ", "msfconsole ", "msfvenom ",
    "burpsuite ", "wpscan ", "amass ", "subfinder ", "nuclei ", "whatweb ", "theharvester ",
    "docker ", "docker-compose ", "kubectl ", "helm ", "terraform ", "ansible ", "vagrant ",
    "git ", "npm ", "yarn ", "cargo ", "go ", "apt ", "apt-get ", "yum ", "dnf ", "brew ", "choco ",
    "GET ", "POST ", "PUT ", "PATCH ", "DELETE ", "OPTIONS ", "HEAD ", "CONNECT ", "TRACE ",
)

#: What a command line looks like.
COMMAND_PATTERNS = (
    r"^\s*(?:sudo\s+)?[a-zA-Z0-9_.-]+\s+--?[a-zA-Z]",
    r"^\s*(?:GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD|CONNECT|TRACE)\s+\S+",
    r"^\s*(?:export\s+)?[A-Z_][A-Z0-9_]*=",
    r"(?i)^\s*(?:SELECT|INSERT|UPDATE|DELETE|UNION|CREATE|DROP|ALTER|GRANT|EXEC)\s+",
    r"^\s*(?:\$|#|>|%)\s+\S",
    r"^\s*PS(?:\s+[A-Z]:\\[^>]*)?>\s*\S",
    r"^\s*[a-zA-Z0-9_./-]+\s*\|\s*[a-zA-Z0-9_./-]+",
    r"^\s*[a-zA-Z0-9_./-]+.*(?:>>|>|<)\s*\S+",
    r"^\s*(?:https?://|ftp://|ws://|wss://)\S+",
    r"^\s*(?:/[a-zA-Z0-9_.-]+){2,}/?\s*$",
    r"^\s*[A-Za-z]:\\(?:[^\\/:*?\"<>|\r\n]+\\)*[^\\/:*?\"<>|\r\n]*\s*$",
    r'^\s*"[a-zA-Z0-9_.-]+"\s*:\s*\S',
    r"^\s*(?:\d{1,3}\.){3}\d{1,3}(?:/\d{1,2})?\s*$",
    r"^\s*(?:pip3?|npm|yarn|cargo|go|apt(?:-get)?|yum|dnf|brew|choco|gem)\s+(?:install|add|get|update)\s+\S+",
    r"^\s*(?:docker|kubectl|helm)\s+[a-z]+\s+\S+",
    r"^\s*git\s+(?:clone|commit|push|pull|checkout|merge|rebase|log)\b",
    r"^\s*-[a-zA-Z](?:,\s*--[a-zA-Z-]+)?\s",
    r"^\s*[a-zA-Z_][a-zA-Z0-9_]*\([^)]*\)\s*$",
)

_SPECIAL = str.maketrans({c: "\\" + c for c in "$.\\"})
PREFIX_PATTERN = r"^\s*(?:" + "|".join(p.translate(_SPECIAL) for p in COMMAND_PREFIXES) + ")"




#: The same lines by fewer steps: what cannot match in another way is not tried again from each place of a line's first word.
_FEWER_STEPS = {
    COMMAND_PATTERNS[0]: r"^\s*(?:sudo\s+)?[a-zA-Z0-9_.-]++\s++--?[a-zA-Z]",
    COMMAND_PATTERNS[6]: r"^\s*[a-zA-Z0-9_./-]++\s*+\|\s*+[a-zA-Z0-9_./-]",
    COMMAND_PATTERNS[7]: r"^\s*[a-zA-Z0-9_./-].*[<>]\s*\S",
    COMMAND_PATTERNS[-1]: r"^\s*[a-zA-Z_][a-zA-Z0-9_]*+\([^)]*+\)\s*$",
}


def _alternative(pattern: str) -> str:
    """A pattern without its start, which all of them share."""
    rest = _FEWER_STEPS.get(pattern, pattern).removeprefix("(?i)").removeprefix(r"^\s*")
    return f"(?i:{rest})" if pattern.startswith("(?i)") else f"(?:{rest})"


#: One pattern for all: a line is turned into a Java string once instead of once for each.
COMMAND = r"^\s*(?:" + "|".join(map(_alternative, (PREFIX_PATTERN, *COMMAND_PATTERNS))) + ")"


def is_command(line: Column) -> Column:
    return line.rlike(COMMAND)


def span_fields(flags: Column) -> Column:
    """The booleans in a span's flag bits."""
    bit = lambda k: flags.bitwiseAND(1 << k) > 0
    return F.struct(bit(0).alias("is_superscript"), bit(1).alias("is_italic"), bit(3).alias("is_monospaced"), bit(4).alias("is_bold"))


def line_fields(spans: Column) -> Column:
    """Text, monospaced ratio and command flag of a line from its spans ``text, is_monospaced``."""
    whole = F.array_join(F.transform(spans, lambda s: s["text"]), "")
    length = F.aggregate(spans, F.lit(0), lambda a, s: a + F.length(s["text"]))
    mono = F.aggregate(spans, F.lit(0), lambda a, s: a + F.when(s["is_monospaced"], F.length(s["text"])).otherwise(0))
    ratio = F.bround(F.when(length > 0, mono / length).otherwise(0.0), 4)
    return T.let(whole, lambda t: F.struct(t.alias("text"), ratio.alias("monospaced_ratio"), is_command(t).alias("contains_command_pattern")))


def classify_code(lines: DataFrame, *keys: str) -> DataFrame:
    """Per block ``likely_code_block`` and ``code_confidence`` from lines ``text, monospaced_ratio``."""
    size = F.length("text")
    per = lines.groupBy(*keys).agg(
        F.sum(size).alias("total"),
        F.sum(F.floor(size * F.col("monospaced_ratio"))).alias("mono"),
        F.count_if(is_command(F.col("text"))).alias("commands"),
        F.count("*").alias("n"),
    )
    return per.select(*keys, *code_verdict(F.when(F.col("total") > 0, F.col("mono") / F.col("total")).otherwise(0.0), F.col("commands"), F.col("n")))


def code_verdict(mono: Column, commands: Column, lines: Column) -> tuple[Column, Column]:
    ratio = commands / lines
    likely = (mono >= 0.55) | (ratio >= 0.40) | ((mono >= 0.30) & (commands > 0))
    return likely.alias("likely_code_block"), F.bround(F.greatest(mono, ratio), 4).alias("code_confidence")


def flatten(pages: DataFrame) -> DataFrame:
    """Blocks of nested pages (``document_id, page_number, blocks``) without margins and blank text."""
    rows = pages.select("document_id", "page_number", F.explode("blocks").alias("block"))
    block = rows.select("document_id", "page_number", "block.*")
    kept = block.filter(~F.coalesce(F.col("is_repeated_margin"), F.lit(False))).withColumn("text", T.strip(F.col("text"))).filter("text <> ''")
    return kept.withColumn("source_block_id", F.format_string("page-%04d/block-%03d", F.col("page_number"), F.col("block_index")))


def units(blocks: DataFrame, first_page: int = 1, last_page: int | None = None) -> DataFrame:
    """Blocks within the content pages, numbered from 0 in reading order within the document."""
    inside = F.col("page_number") >= first_page
    if last_page is not None:
        inside = inside & (F.col("page_number") <= last_page)
    order = W.partitionBy("document_id").orderBy("page_number", "block_index")
    mono = F.floor(F.length("text") * F.col("monospaced_ratio")) / F.length("text")
    likely, confidence = code_verdict(mono, F.when(is_command(F.col("text")), 1).otherwise(0), F.lit(1))
    return blocks.filter(inside).withColumns({"global_index": F.row_number().over(order) - 1, "likely_code_block": likely, "code_confidence": confidence})


def units_of_pages(pages: DataFrame, first_page: Column | int = 1, last_page: Column | None = None) -> DataFrame:
    """Units from nested pages (``blocks`` with ``lines`` of ``spans``): text and font statistics of each block that is no margin and not blank.

    Spans count with their text stripped.  ``font_weights`` has characters by
    half-point size in order of appearance.  The page bounds may be columns of
    ``pages``; a null upper bound is none.
    """
    inside = F.col("page_number") >= first_page
    if last_page is not None:
        inside = inside & (last_page.isNull() | (F.col("page_number") <= last_page))
    kept = flatten(pages.filter(inside))
    size = lambda s: F.length(T.strip(s["text"]))
    spans = F.filter(F.flatten(F.transform("lines", lambda x: x["spans"])), lambda s: size(s) > 0)
    total = lambda own, when=None: F.aggregate(own, F.lit(0), lambda a, s: a + (size(s) if when is None else F.when(F.coalesce(s[when], F.lit(False)), size(s)).otherwise(0)))
    rows = kept.withColumn("_s", F.coalesce(spans, F.expr("filter(array(named_struct('text', '', 'font_size', 0D, 'is_bold', false, 'is_monospaced', false)), x -> false)"))).withColumn("_n", total(F.col("_s")))
    share = lambda when: F.when(F.col("_n") > 0, total(F.col("_s"), when) / F.col("_n")).otherwise(0.0)
    order = W.partitionBy("document_id").orderBy("page_number", "block_index")
    return rows.select(
        "document_id",
        (F.row_number().over(order) - 1).alias("global_index"),
        "source_block_id",
        "page_number",
        "block_index",
        "text",
        F.size("lines").alias("line_count"),
        F.coalesce("likely_code_block", F.lit(False)).alias("likely_code_block"),
        F.coalesce(F.array_max(F.transform("_s", lambda s: s["font_size"])), F.lit(0.0)).alias("font_size"),
        share("is_bold").alias("bold_ratio"),
        share("is_monospaced").alias("monospaced_ratio"),
        F.transform("_s", lambda s: F.struct(half_point(s["font_size"]).alias("size"), size(s).alias("n"))).alias("font_weights"),
    )


def font_statistics(spans: DataFrame, *keys: str) -> DataFrame:
    """Per block: characters, bold and monospaced shares, largest size, from spans ``text, font_size, is_bold, is_monospaced``."""
    size = F.length("text")
    share = lambda flag: F.bround(F.sum(F.when(F.col(flag), size).otherwise(0)) / F.sum(size), 4)
    return spans.filter(size > 0).groupBy(*keys).agg(F.sum(size).alias("characters"), share("is_bold").alias("bold_ratio"), share("is_monospaced").alias("monospaced_ratio"), F.max("font_size").alias("maximum_font_size"))


def font_histogram(spans: DataFrame, *keys: str) -> DataFrame:
    """Per key and size in half points (``size``) the ``characters`` of spans ``text, font_size``, their texts stripped; blank ones do not count, spans without a size have 0."""
    n = F.length(T.strip(F.col("text")))
    sized = spans.filter(n > 0).withColumns({"size": half_point(F.coalesce(F.col("font_size"), F.lit(0.0))), "_n": n})
    return sized.groupBy(*keys, "size").agg(F.sum("_n").alias("characters"))


def half_point(size: Column) -> Column:
    return F.bround(size * 2) / 2


def margin_signature(text: Column, y0: Column, y1: Column, height: Column) -> Column:
    """``top:`` or ``bottom:`` and the normalised text of a block in a page's margin, else null."""
    region = F.when(y1 <= height * 0.12, "top").when(y0 >= height * 0.88, "bottom")
    body = T.strip(text)
    # most blocks are in no margin or too long: their text is not normalised
    signed = T.let(T.margin_text(body), lambda n: F.when(n != "", F.concat(region, F.lit(":"), n)))
    return F.when((height > 0) & region.isNotNull(), F.when(F.length(body) <= 180, signed))


def signatures(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("signature", margin_signature(F.col("text"), F.col("y0"), F.col("y1"), F.col("height")))


def repeated_margins(blocks: DataFrame) -> DataFrame:
    """``document_id, signature, pages`` of margin texts on at least ``max(4, min(12, 5 %))`` of a document's pages."""
    marked = signatures(blocks)
    pages = marked.select("document_id", "page_number").distinct().groupBy("document_id").agg(F.count("*").alias("page_count"))
    seen = marked.filter("signature IS NOT NULL").select("document_id", "signature", "page_number").distinct().groupBy("document_id", "signature").agg(F.count("*").alias("pages"))
    least = F.greatest(F.lit(4), F.least(F.lit(12), F.ceil(F.col("page_count") * 0.05)))
    return seen.join(pages, "document_id").filter(F.col("pages") >= least).select("document_id", "signature", "pages")


def mark_margins(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``is_repeated_margin``."""
    marked = signatures(blocks)
    repeated = repeated_margins(blocks).select("document_id", "signature", F.lit(True).alias("hit"))
    return marked.join(repeated, ["document_id", "signature"], "left").withColumn("is_repeated_margin", F.coalesce("hit", F.lit(False))).drop("hit", "signature")


def remove_margins(blocks: DataFrame) -> DataFrame:
    """Pages recounted without repeated margins: ``document_id, page_number, character_count, word_count, removed_count, has_native_text``."""
    flagged = mark_margins(blocks)
    kept = F.when(~F.col("is_repeated_margin") & (T.strip(F.col("text")) != ""), F.struct("block_index", T.strip(F.col("text")).alias("t")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["t"]), "\n\n")
    pages = flagged.groupBy("document_id", "page_number").agg(body.alias("text"), F.count_if("is_repeated_margin").alias("removed_count"))
    return pages.select("document_id", "page_number", F.length("text").cast("long").alias("character_count"), T.word_count(F.col("text")).alias("word_count"), "removed_count", (F.col("text") != "").alias("has_native_text"))


def page_records(pages: DataFrame, blocks: DataFrame, images: DataFrame, tables: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """A record for each of ``pages`` (``document_id, page_number, width, height, rotation``).

    ``blocks`` have ``block_index, text, is_repeated_margin,
    likely_code_block``, ``images`` ``image_id, page_coverage_ratio``,
    ``tables`` ``table_id``, all with document and page.  A page in ``errors``
    (``extraction_error``) failed: it has no content, method ``failed`` and the
    message.  Pages without images have coverage 0.
    """
    key = ["document_id", "page_number"]
    clean = T.strip(F.col("text"))
    kept = F.when(~F.col("is_repeated_margin") & (clean != ""), F.struct("block_index", clean.alias("t")))
    gone = F.when(F.col("is_repeated_margin"), F.struct("block_index", clean.alias("t")))
    texts = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda y: y["t"])
    body = blocks.groupBy(*key).agg(F.array_join(texts(kept), "\n\n").alias("text"), texts(gone).alias("removed_margin_text"), F.bool_or("likely_code_block").alias("has_code"))
    pictures = images.groupBy(*key).agg(F.array_sort(F.collect_list("image_id")).alias("image_ids"), F.max("page_coverage_ratio").alias("cover"))
    grids = tables.groupBy(*key).agg(F.array_sort(F.collect_list("table_id")).alias("table_ids"))
    rows = pages.join(body, key, "left").join(pictures, key, "left").join(grids, key, "left")
    rows = rows.withColumn("extraction_error", F.lit(None).cast("string")) if errors is None else rows.join(errors.select(*key, "extraction_error"), key, "left")
    well = F.col("extraction_error").isNull()
    empty = F.array().cast("array<string>")
    of = lambda c, default: F.when(well, F.coalesce(c, default)).otherwise(default)
    rows = rows.withColumns({"text": of("text", F.lit("")), "image_ids": of("image_ids", empty), "table_ids": of("table_ids", empty), "removed_margin_text": of("removed_margin_text", empty), "cover": of("cover", F.lit(0.0)), "has_code": of("has_code", F.lit(False))})
    return rows.select(
        *key,
        F.bround("width", 3).alias("width"),
        F.bround("height", 3).alias("height"),
        "rotation",
        "text",
        F.length("text").cast("long").alias("character_count"),
        T.word_count(F.col("text")).alias("word_count"),
        (F.col("text") != "").alias("has_native_text"),
        F.when(well, "native").otherwise("failed").alias("extraction_method"),
        "image_ids",
        F.size("image_ids").alias("image_count"),
        F.col("cover").alias("max_image_coverage_ratio"),
        "table_ids",
        F.size("table_ids").alias("table_count"),
        "removed_margin_text",
        F.size("removed_margin_text").alias("removed_count"),
        "has_code",
        "extraction_error",
    )


def extraction_report(pages: DataFrame, toc: DataFrame, images: DataFrame, tables: DataFrame, repeated: DataFrame) -> DataFrame:
    """One report for each document of ``page_records``, with its lists of pages and a warning for each failed page."""
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("page_number"))))
    n = F.col("character_count")
    failed = F.when(F.col("extraction_error").isNotNull(), F.struct("page_number", F.concat(F.lit("Page extraction failed on page "), F.col("page_number").cast("string"), F.lit(": "), F.col("extraction_error")).alias("said")))
    rows = pages.groupBy("document_id").agg(
        F.count("*").alias("page_count"),
        F.sum(n).alias("total_character_count"),
        listed(n == 0).alias("empty_pages"),
        listed((n > 0) & (n < 80)).alias("low_text_pages"),
        listed((n < 50) & (F.col("max_image_coverage_ratio") >= 0.60)).alias("image_only_candidate_pages"),
        listed(F.col("has_code")).alias("pages_with_code_blocks"),
        listed(F.col("table_count") > 0).alias("pages_with_tables"),
        listed(F.col("image_count") > 0).alias("pages_with_images"),
        F.transform(F.array_sort(F.collect_list(failed)), lambda x: x["said"]).alias("warnings"),
    )
    for extra, name in ((toc, "toc_entry_count"), (images, "image_metadata_count"), (tables, "table_count"), (repeated, "repeated_margin_signature_count")):
        rows = rows.join(extra.groupBy("document_id").agg(F.count("*").alias(name)), "document_id", "left").fillna(0, [name])
    return rows.withColumns(
        {
            "empty_page_count": F.size("empty_pages").cast("long"),
            "low_text_page_count": F.size("low_text_pages").cast("long"),
            "schema_version": F.lit("1.0"),
            "generated_at": utc_now(),
            "ocr_used": F.lit(False),
        }
    )


def utc_now() -> Column:
    """The query's time in UTC, as an ISO string."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
