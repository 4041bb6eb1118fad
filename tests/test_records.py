"""Sections by outline, records from atoms, deep outlines and the command line, against plain Python."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lectern import cli
from lectern.functions import text as T
from lectern.plans import registry
from lectern.operators import chunking, headings, index, layout, retrieval, sections

BLOCKS = "document_id string, source_block_id string, text string, page_number int, likely_code_block boolean"
SECTION = "schema_version string, document_id string, section_id string, parent_section_id string, section_number int, title string, heading_path array<string>, level int, page_start int, page_end int, text string, contains_code boolean, indexable boolean, source_block_ids array<string>, source struct<title:string,publication_year:int>"


def section(n, ids, text="own text", indexable=True):
    return ("1.0", "d", f"d/{n:04d}-s", None, n, f"S{n}", [f"S{n}"], 1, 3, 9, text, False, indexable, ids, ("Book", 2020))


def test_parents_and_chunks_come_from_atoms(spark):
    words = lambda n: " ".join(f"w{k}" for k in range(n))
    blocks = spark.createDataFrame([("d", "b1", "  head \n line ", 4, False), ("d", "b2", words(25), 5, True), ("d", "b3", " ", 6, False)], BLOCKS)
    found = spark.createDataFrame([section(1, ["b1", "b2", "gone"]), section(2, ["gone"], words(13)), section(3, ["b3"], ""), section(4, ["b1"], indexable=False)], SECTION)
    atoms = chunking.atoms(found.filter("indexable"), blocks, 10)
    got = {r.section_id[-6:]: r for r in chunking.parents(found, atoms).collect()}
    assert set(got) == {"0001-s", "0002-s", "0003-s"}
    a, b, c = got["0001-s"], got["0002-s"], got["0003-s"]
    cut = [" ".join(f"w{k}" for k in range(i, min(i + 10, 25))) for i in (0, 10, 20)]
    assert a.text == "\n\n".join(["head \n line", *cut]) and (a.page_start, a.page_end, a.contains_code) == (4, 5, True)
    assert a.source_block_ids == ["b1", "b2"] and a.citation.document_title == "Book" and a.citation.page_start == 4
    assert b.text == " ".join(f"w{k}" for k in range(10)) + "\n\nw10 w11 w12" and b.source_block_ids == ["section-fallback/001", "section-fallback/002"] and b.page_start == b.page_end == 3
    assert c.text == "" and c.source_block_ids == [] and (c.page_start, c.page_end) == (3, 9)
    made = chunking.chunk_records(found, atoms, 10, 0, 3, distinct=False)
    report = chunking.full_report(found, blocks, made).first()
    assert (report.source_section_count, report.indexable_section_count, report.parent_count) == (4, 3, 3)
    assert report.missing_source_blocks == ["gone"] and report.missing_source_block_count == 1
    assert report.duplicate_chunk_count == 1  # the first ten words of two sections
    assert set(retrieval.PAYLOAD) <= set(made.columns)
    assert {r.embedding_text.split("\n")[0] for r in made.collect()} == {"Document: Book"}


def test_outlines_of_any_depth(spark):
    rows = [("d", f"e{i:02d}", f"t{i}", i + 1, i) for i in range(12)] + [("d", "e99", "last", 12, 99)]
    events = spark.createDataFrame(rows, "document_id string, event_id string, title string, level int, anchor_index int")
    made = headings.with_level_paths(headings.with_parents(events))
    got = {r.event_id: r for r in made.collect()}
    assert got["e11"].parent_event_id == "e10" and got["e11"].heading_path == [f"t{i}" for i in range(12)]
    assert got["e99"].parent_event_id == "e10" and len(got["e99"].heading_path) == 12
    paths = {r.event_id: r.heading_path for r in headings.heading_paths(made.drop("heading_path")).collect()}
    assert paths == {k: r.heading_path for k, r in got.items()}


UNIT = "document_id string, global_index int, source_block_id string, page_number int, block_index int, text string, line_count int, likely_code_block boolean, font_size double, bold_ratio double"


def unit(d, k, page, text, size=10.0):
    return (d, k, f"page-{page:04d}/block-{k:03d}", page, k, text, 1, False, size, 0.0)


def test_detection_by_mode(spark):
    text = "plain words that fill a block and end with a full stop so that nobody takes them for a heading."
    rows = []
    for d in ("toc", "font", "auto", "bare"):
        rows += [unit(d, 0, 1, "First Chapter", 16.0), unit(d, 1, 1, text), unit(d, 2, 2, "Part of it", 12.0), unit(d, 3, 2, text), unit(d, 4, 3, text), unit(d, 5, 3, "Unlisted heading", 12.0)]
    units = spark.createDataFrame(rows, UNIT)
    entries = [(1, "toc-0001", None, "First chapter", 1, 1), (2, "toc-0002", "toc-0001", "Part of  it", 2, 2), (3, "toc-0003", "toc-0002", "Not in any text at all", 3, 3), (4, "toc-0004", None, "Beyond the end", 1, 90)]
    outline = spark.createDataFrame([(d, *e) for d in ("toc", "font", "auto") for e in entries], "document_id string, toc_order int, toc_id string, parent_toc_id string, title string, level int, page_number int")
    records = spark.createDataFrame([("toc", "toc"), ("font", "font"), ("auto", None), ("bare", "other")], "document_id string, section_detection string")
    modes = headings.detection_modes(records, outline)
    assert {r.document_id: r.detection_mode for r in modes.collect()} == {"toc": "toc", "font": "font", "auto": "toc", "bare": "font"}
    events, anchors = headings.detect(units, outline, modes)
    made = sections.build(units, events).orderBy("document_id", "section_number").collect()
    got = {d: [(r.title, r.heading_path, r.detection.method, r.quality_flags) for r in made if r.document_id == d] for d in ("toc", "auto", "font", "bare")}
    assert got["toc"] == got["auto"]
    assert [t for t, *_ in got["font"]] == [t for t, *_ in got["bare"]] == ["First Chapter", "Part of it", "Unlisted heading"]
    assert [(t, p, m) for t, p, m, _ in got["toc"]] == [
        ("First chapter", ["First chapter"], "toc-text-anchor"),
        ("Part of it", ["First chapter", "Part of it"], "toc-text-anchor"),
        ("Not in any text at all", ["First chapter", "Part of it", "Not in any text at all"], "toc-heading-fallback"),
    ]
    assert {"fallback-heading-anchor", "low-anchor-confidence"} <= set(got["toc"][2][3])
    said = {r.document_id: r.warnings for r in headings.toc_warnings(anchors, outline).collect()}
    assert said == {d: ["Could not resolve TOC entry 'Beyond the end' on page 90."] for d in ("toc", "auto")}


def test_units_of_pages(spark):
    span = lambda t, size, bold=False, mono=False: (t, size, bold, mono)
    blocks = [(0, " Title ", [("Title", [span("Title", 16.2, True)])], False, False), (1, "body text", [("body", [span("body", 10.1), span("  ", 40.0)]), ("text", [span("text", 10.3, False, True)])], None, None), (2, "margin", [], False, True), (3, "  ", [], False, False), (4, "no spans", None, True, False)]
    from lectern.plans.process import PAGE

    pages = spark.createDataFrame([("d", 2, blocks), ("d", 9, blocks)], PAGE)
    got = layout.units_of_pages(pages, 1, F.lit(5)).orderBy("global_index").collect()
    assert [(r.global_index, r.text, r.font_size, r.bold_ratio, r.monospaced_ratio) for r in got] == [(0, "Title", 16.2, 1.0, 0.0), (1, "body text", 10.3, 0.0, 0.5), (2, "no spans", 0.0, 0.0, 0.0)]
    assert [(w.size, w.n) for w in got[1].font_weights] == [(10.0, 4), (10.5, 4)] and got[2].likely_code_block
    # the title has five characters on each page, either size of the body four
    assert headings.body_font_size(layout.units_of_pages(pages)).first().body_font_size == 16.0


def test_failed_and_empty_pages(spark):
    pages = spark.createDataFrame([("d", p, 612.0, 792.0, 0) for p in (1, 2, 3)], "document_id string, page_number int, width double, height double, rotation int")
    blocks = spark.createDataFrame([("d", 1, 0, "x" * 90, False, True), ("d", 1, 1, "foot", True, False), ("d", 2, 0, "lost", False, False)], "document_id string, page_number int, block_index int, text string, is_repeated_margin boolean, likely_code_block boolean")
    images = spark.createDataFrame([("d", 2, "i1", 2.1), ("d", 3, "i2", 0.7)], "document_id string, page_number int, image_id string, page_coverage_ratio double")
    tables = spark.createDataFrame([("d", 1, "t1")], "document_id string, page_number int, table_id string")
    errors = spark.createDataFrame([("d", 2, "broken")], "document_id string, page_number int, extraction_error string")
    made = layout.page_records(pages, blocks, images, tables, errors)
    got = {r.page_number: r for r in made.collect()}
    assert got[1].removed_margin_text == ["foot"] and got[1].has_code and got[1].max_image_coverage_ratio == 0.0
    assert (got[2].extraction_method, got[2].text, got[2].image_count, got[2].extraction_error) == ("failed", "", 0, "broken")
    r = layout.extraction_report(made, tables.limit(0), images, tables, tables.limit(0)).first()
    assert (r.empty_pages, r.low_text_pages, r.image_only_candidate_pages, r.pages_with_code_blocks, r.pages_with_tables, r.pages_with_images) == ([2, 3], [], [3], [1], [1], [3])
    assert r.warnings == ["Page extraction failed on page 2: broken"] and r.generated_at.endswith("+00:00") and r.toc_entry_count == 0


def test_near_ties_are_ranked_by_full_scores(spark):
    rows = [(1, "a", 0.50000012), (1, "b", 0.50000034), (1, "c", 0.5)]
    got = retrieval.ranked(spark.createDataFrame(rows, "query_id int, k string, score double"), "k", 2).orderBy("rank").collect()
    assert [(r.k, r.score) for r in got] == [("b", 0.5), ("a", 0.5)]


def test_hashed_terms(spark):
    rows = spark.createDataFrame([(1, "alpha beta beta"), (2, ""), (3, None), (4, "Beta alpha BETA")], "k long, t string")
    got = {r.k: r.embedding for r in index.hashed_terms(rows, "k", "t").collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-9 and got[1] == got[4] and set(got[2]) == set(got[3]) == {0.0}


MANIFEST = """# books
documents:
  - id: book-one   # the first
    path: a/b/one.pdf
    title: "Guide #1 to C # things"
    publication_year: 2020
    document_type: book
    domain: 'web: security'
    chunk_profile: command_reference
    section_detection: font
    chapter_starts:
      - page: 1
        title: Opening
      - page: 2
        title: "Second: part"
        level: 1
    tags: [one, 'two, three']
    chunking:
      maximum_tokens: 40
      overlap_tokens: 12
  - id: two
    path: two.pdf
    title: Two
    publication_year: 2021
    document_type: book
    domain: web
    chunk_profile: default
    content_start_page: 2
"""


def test_manifest_values():
    from lectern.sources.readers import ManifestError, manifest_entries

    one, two = manifest_entries(MANIFEST)
    assert one["title"] == "Guide #1 to C # things" and one["domain"] == "web: security" and one["tags"] == ["one", "two, three"]
    assert one["chapter_starts"] == [{"page": 1, "title": "Opening"}, {"page": 2, "title": "Second: part", "level": 1}]
    assert one["chunking"] == {"maximum_tokens": 40, "overlap_tokens": 12} and two["content_start_page"] == 2
    assert manifest_entries(json.dumps({"documents": [one, two]})) == [one, two]
    assert manifest_entries("documents:\n") == manifest_entries("") == []
    for bad in ("documents: 3", "documents:\n  - a\n", "documents:\n  - id: x\n what"):
        with pytest.raises(ManifestError):
            manifest_entries(bad)


def test_command_line(spark, tmp_path):
    (tmp_path / "m.yaml").write_text(MANIFEST)
    line = lambda t, size, bold=False: {"text": t, "spans": [{"text": t, "font_size": size, "is_bold": bold, "is_monospaced": False}]}
    block = lambda k, t, size=10.0: {"block_index": k, "text": t, "lines": [line(t, size)], "likely_code_block": False, "is_repeated_margin": False}
    prose = lambda w: " ".join(f"{w}{k}" for k in range(30)) + "."
    for d in ("book-one", "two"):
        folder = tmp_path / "in" / d
        folder.mkdir(parents=True)
        pages = [{"document_id": d, "page_number": p, "blocks": [block(0, f"Chapter {p} of {d}", 16.0), block(1, prose(f"{d}x{p}a")), block(2, prose(f"shared{p}b"))]} for p in (1, 2, 3)]
        (folder / "pages.jsonl").write_text("\n".join(map(json.dumps, pages)))
    paths = ["--manifest", str(tmp_path / "m.yaml"), "--processed", str(tmp_path / "out")]
    said = cli.run(spark, ["sections", *paths, "--extracted", str(tmp_path / "in")])
    assert said == ["[OK] book-one: 3 sections, 3 indexable, mode=font", "[OK] two: 2 sections, 2 indexable, mode=font"]
    titles = {r.title for r in spark.read.parquet(str(tmp_path / "out" / "sections")).filter("document_id = 'book-one'").collect()}
    assert titles == {"Opening", "Second: part", "Chapter 3 of book-one"}
    assert len(cli.run(spark, ["chunks", *paths])) == 2
    chunks = spark.read.parquet(str(tmp_path / "out" / "chunks"))
    assert chunks.filter("document_id = 'book-one'").agg(F.max("token_count_approx")).first()[0] <= 40
    where = ["--processed", str(tmp_path / "out"), "--index", str(tmp_path / "index")]
    assert cli.run(spark, ["index", *where])[0].startswith("Chunks: ")
    with pytest.raises(Exception, match="(?i)exists"):
        cli.run(spark, ["index", *where])
    found = cli.run(spark, ["search", *where, "--query", "shared2b1 shared2b2", "--document", "two", "--top-k", "2", "--output", str(tmp_path / "answer")])
    assert "two/" in found[0] and all("book-one" not in x.split("\n")[0] for x in found) and any(x.startswith("[parent]") for x in found)
    hits = spark.read.json(str(tmp_path / "answer" / "hits"))
    assert hits.orderBy("position").first().text.find("shared2b1") >= 0
    with pytest.raises(ValueError, match="no such document"):
        cli.run(spark, ["search", *where, "--query", "x", "--document", "three"])
    with pytest.raises(Exception, match="not in the manifest"):
        cli.run(spark, ["chunks", *paths, "--document", "three"])


def test_skeleton_boxes_and_lines(spark, tmp_path):
    from lectern.sources import readers

    row = spark.range(1).select(
        T.heading_skeleton(F.lit(" Chapter ①: Über C++ ")).alias("s"),
        T.rounded_box(F.array(F.lit(1.23456), F.lit(2.0), F.lit(4.0), F.lit(3.5))).alias("b"),
        T.area(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0), F.lit(4.0))).alias("a"),
        T.area(F.array(F.lit(4.0), F.lit(2.0), F.lit(1.0), F.lit(4.0))).alias("n"),
    ).first()
    assert (row.s, row.b, row.a, row.n) == ("chapter1berc", [1.235, 2.0, 4.0, 3.5], 6.0, 0.0)
    f = tmp_path / "x.jsonl"
    f.write_text("".join('{"a": 1}\n' if k % 97 else ("no\n" if k else "\n") for k in range(500)) + "[1]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert sorted(r.line for r in readers.bad_lines(spark, str(f), "a int").collect()) == [98, 195, 292, 389, 486, 501]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_units_find_their_sections_in_one_exchange(spark):
    units = spark.createDataFrame([("d", k, f"t{k}") for k in range(6)], "document_id string, global_index int, text string")
    events = spark.createDataFrame([("d", 1, "e1"), ("d", 4, "e4")], "document_id string, anchor_index int, event_id string")
    made = sections.assign(units, events)
    assert sorted((r.global_index, r.event_id) for r in made.collect()) == [(1, "e1"), (2, "e1"), (3, "e1"), (4, "e4"), (5, "e4")]
    assert made.columns == ["document_id", "global_index", "text", "event_id"]
    assert made._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


def test_stages_by_document_deal_no_text_again(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c = registry.Corpus(spark, "/root/testdata/sf0.001")
        placed = sections.assign(c.units, c.events, together=True)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (placed, c.atoms)]
        assert all("Exchange" not in plan and "SortMergeJoin" in plan for plan in plans)
        assert placed.count() == sections.assign(c.units, c.events).count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_headings_with_odd_beginnings(spark):
    texts = [" ­Chap­ter\t1", " PART two", "appendix", "Chapterless", "plain", "­­ partial", " Appendix ­ A", ""]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = {r.k: (r.a, r.b) for r in rows.select("k", headings._explicit(F.col("text")).alias("a"), T.collapse_whitespace(F.col("text")).rlike(T.EXPLICIT_HEADING).alias("b")).collect()}
    assert all(a == b for a, b in got.values()) and [k for k, (a, _) in sorted(got.items()) if a] == [0, 1, 6]
    # regular expressions stand behind conditions only, so what most rows share is not made for all of them
    assert "CASE WHEN" in rows.select(headings._explicit(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()


def test_commands_in_few_steps(spark):
    """One pattern takes the lines of all patterns, and a line of one long word takes no time that grows with its square."""
    random.seed(5)
    bits = ["sudo ", "ls", " ", "  ", "-", "--a", "-x", "|", " | ", ">", ">>", "<", "\n", "\t", "a.b/c", "main", "(", ")", "x)", "()", "Ä", "_", "=", "A_B", "1.2.3.4", "é >", "\x85"]
    lines = ["".join(random.choices(bits, k=random.randrange(1, 7))) for _ in range(6000)]
    rows = spark.createDataFrame([(x,) for x in lines], "text string")
    plain = F.lit(False)
    for p in (layout.PREFIX_PATTERN, *layout.COMMAND_PATTERNS):
        plain = plain | F.col("text").rlike(p)
    assert rows.filter(layout.is_command(F.col("text")) != plain).count() == 0
    assert 500 < rows.filter(plain).count() < 5500
    start = time.perf_counter()
    assert spark.range(1).filter(layout.is_command(F.concat(F.repeat(F.lit("a"), F.lit(3000)), F.repeat(F.lit(" ä"), F.lit(300_000)), F.col("id").cast("string")))).count() == 0
    assert time.perf_counter() - start < 10


def test_slices_are_counted_once(spark):
    random.seed(6)
    bits = ["wort", "é", "_", "7", ".", "...", " ", "  ", "\n", "\u2003", "-", "\xad", "a1_b"]
    lines = [None, "", " \n", *("".join(random.choices(bits, k=random.randrange(1, 60))) for _ in range(500))]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, text string")
    for most in (1, 3, 200):
        plain = F.transform(T.split_tokens(F.col("text"), most), lambda s: F.struct(s.alias("text"), T.token_count(s).alias("tokens")))
        assert rows.filter(~T.split_counted(F.col("text"), most).eqNullSafe(plain)).count() == 0
    # a text is counted by one pattern and cut by another; its slices are not counted again
    cut = chunking.atoms(spark.createDataFrame([section(1, ["a"])], SECTION), spark.createDataFrame([("d", "a", "x " * 500, 1, False)], BLOCKS), 200)
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2
    assert [r.token_count for r in cut.orderBy("part").collect()] == [200, 200, 100]


def test_parents_of_few_hits_are_those_of_all(spark, monkeypatch):
    c = registry.Corpus(spark, "/root/testdata/sf0.001")
    hits = c.sections.filter("indexable AND document_id < 'doc-000020' AND character_count % 3 = 0").select("document_id", F.col("section_id").alias("parent_id"))
    want = sorted(map(str, c.parents.join(hits, ["document_id", "parent_id"], "left_semi").select(c.parents.columns).collect()))
    few = c.parents_of(hits)
    assert sorted(map(str, few.collect())) == want and len(want) > 5
    monkeypatch.setattr(registry.index, "SENT", 0)
    assert c.parents_of(hits) is c.parents


def test_merged_texts_make_the_stages_once(spark, monkeypatch):
    made, plain = [], registry.layout.units
    monkeypatch.setattr(registry.layout, "units", lambda *a: (made.append(a), plain(*a))[1])
    assert registry.search_merged_text(spark, "/root/testdata/sf0.001").count() > 0 and len(made) == 1
