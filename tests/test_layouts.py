"""Tables of pages, outline anchors and the ledger of files, against plain Python."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from lectern import cli
from lectern.functions import text as T
from lectern.operators import headings, tables
from lectern.plans import registry
from lectern.sources import ledger, readers

SPAN = "document_id string, page_number int, x0 double, y0 double, x1 double, y1 double, text string"


def test_a_table_between_lines(spark):
    row = lambda y, *words: [("d", 1, 50.0 + 100 * k, y, 50.0 + 100 * k + 5 * len(w), y + 10, w) for k, w in enumerate(words) if w]
    spans = [("d", 1, 50.0, 20.0, 300.0, 30.0, "A line of prose.")] + row(40.0, "Name", "Size | unit", "Note") + row(54.0, "a", "", "x\ny") + row(68.0, "b", "2", "")
    spans += [("d", 1, 50.0, 120.0, 300.0, 130.0, "More prose.")] + row(140.0, "only", "one", "row") + [("d", 1, 50.0, 200.0, 45.0, 210.0, "bad"), ("d", 2, None, 1.0, 2.0, 3.0, "lost"), ("d", 2, 1.0, 1.0, 2.0, 3.0, None), (None, None, 0.0, 0.0, 9.0, 9.0, "x")]
    got = tables.tables(spark.createDataFrame(spans + spans[:3], SPAN)).collect()
    assert [(r.table_id, r.row_count, r.column_count, r.error) for r in got] == [("d/page-0001/table-001", 3, 3, None)]
    assert got[0].cells == [["Name", "Size | unit", "Note"], ["a", "", "x\ny"], ["b", "2", ""]] and got[0].bbox == [50.0, 40.0, 270.0, 78.0]
    assert got[0].markdown == "|Name|Size \\| unit|Note|\n|---|---|---|\n|a||x<br>y|\n|b|2||"
    assert sorted(map(tuple, tables.failures(spark.createDataFrame(spans, SPAN)).collect())) == [("d", 1, "Table detection failed on page 1: 1 spans without a box"), ("d", 2, "Table detection failed on page 2: 1 spans without a box")]
    assert tables.tables(spark.createDataFrame([], SPAN)).count() == 0


def test_columns_that_overlap_are_told(spark):
    spans = [("d", 3, 0.0, 0.0, 40.0, 10.0, "a"), ("d", 3, 60.0, 0.0, 100.0, 10.0, "b"), ("d", 3, 0.0, 12.0, 20.0, 22.0, "c"), ("d", 3, 35.0, 12.0, 90.0, 22.0, "d")]
    (got,) = tables.tables(spark.createDataFrame(spans, SPAN)).collect()
    assert (got.column_count, got.markdown, got.cells) == (1, None, [["a b"], ["c d"]]) and got.error.startswith("Table Markdown conversion failed on page 3, table 1")


def plain_choice(entries):
    """Anchors of one document's entries by the rules, in a loop."""
    least, out = 0, []
    for e in sorted(entries, key=lambda e: e["toc_order"]):
        open_ = [u for u in e["near"] if u["global_index"] >= least]
        far = {0: 0, 1: 1, -1: 2}
        best = min((u for u in open_ if u["offset"] in far and u["score"] > 0), key=lambda u: (-u["score"], far[u["offset"]], u["global_index"]), default=None)
        ahead = sorted((u for u in open_ if u["offset"] >= 0), key=lambda u: u["global_index"])
        heads = [u for u in ahead if u["heading"]]
        if best is not None and best["score"] >= headings.ACCEPT:
            found, worth, how = best, round(best["score"], 4), "toc-text-anchor"
        elif heads:
            found, worth, how = heads[0], 0.0, "toc-heading-fallback"
        elif ahead:
            found, worth, how = ahead[0], 0.0, "toc-page-fallback"
        else:
            found, worth, how = None, 0.0, "unresolved"
        if found:
            least = found["global_index"] + 1
        out.append((e["toc_id"], found and found["global_index"], found and found["source_block_id"], worth, how))
    return out


def test_anchors_of_random_outlines(spark):
    random.seed(8)
    unit = "struct<offset:int,global_index:int,unit_page:int,source_block_id:string,score:double,heading:boolean>"
    documents = []
    for d in range(150):
        entries = []
        for k in range(random.randrange(0, 9)):
            near = []
            for g in sorted(random.sample(range(k * 3, k * 3 + 12), random.randrange(0, 8))):
                offset = random.choice([-1, 0, 1, 2])
                near.append((offset, g, 1, f"b{g}", None if offset == 2 else random.choice([0.0, -0.01, 0.3, 0.64, 0.6399, 0.97, 1.0]), random.random() < 0.3))
            entries.append((k, f"t{k}", None, f"T{k}", 1, near))
        documents.append((f"d{d}", entries))
    kind = f"document_id string, entries array<struct<toc_order:int,toc_id:string,parent_toc_id:string,title:string,level:int,near:array<{unit}>>>"
    df = spark.createDataFrame(documents, kind)
    got = {}
    for r in headings.anchored(df).collect():
        got.setdefault(r.document_id, []).append((r.toc_id, r.anchor_index, r.anchor_block_id, r.anchor_score, r.detection_method))
    want = {r.document_id: plain_choice(r.entries) for r in df.collect() if r.entries}
    assert got == want and {x[-1] for v in want.values() for x in v} == {"toc-text-anchor", "toc-heading-fallback", "toc-page-fallback", "unresolved"}


def test_anchors_of_the_query_in_plain_python(spark):
    d = "/root/testdata/sf0.001"
    # the outlines of some documents, with their pages
    toc = registry._toc(spark, d).filter("document_id < 'doc-000025'")
    units = headings.with_body(registry.Corpus(spark, d).units.filter("document_id < 'doc-000025'")).withColumn("heading", headings.is_candidate(F.col("body_font_size")))
    pages = {}
    for u in units.orderBy("global_index").collect():
        pages.setdefault((u.document_id, u.page_number), []).append(u)
    entries = {}
    for t in toc.withColumn("variants", T.title_variants(F.col("title"))).collect():
        near = []
        for offset in (-1, 0, 1, 2):
            for u in pages.get((t.document_id, t.page_number + offset), ()):
                score = None if offset == 2 else min(1.0, T.similarity(list(t.variants), u.text) + 0.03 * u.heading) - 0.04 * abs(offset)
                near.append({"offset": offset, "global_index": u.global_index, "source_block_id": u.source_block_id, "score": score, "heading": u.heading})
        entries.setdefault(t.document_id, []).append({"toc_order": t.toc_order, "toc_id": t.toc_id, "near": near})
    want = sorted((k, *row) for k, own in entries.items() for row in plain_choice(own))
    rows = headings.toc_anchors(toc, registry.Corpus(spark, d).units.filter("document_id < 'doc-000025'")).collect()
    assert sorted((r.document_id, r.toc_id, r.anchor_index, r.anchor_block_id, r.anchor_score, r.detection_method) for r in rows) == want and len(want) > 20


def test_ledger_opens_changed_files_only(spark, tmp_path, monkeypatch):
    folder, book, opened = tmp_path / "in", str(tmp_path / "ledger"), []
    (folder / "sub").mkdir(parents=True)
    for name in ("a", "b", "sub/c"):
        (folder / name).write_text(name)
    digests = readers.file_digests
    monkeypatch.setattr(readers, "file_digests", lambda s, paths: opened.extend(p for p in paths if p != str(folder)) or digests(s, paths))

    def run():
        opened.clear()
        found = ledger.changes(spark, str(folder), book)
        rows = {os.path.basename(r.path): r.change for r in found.collect()}
        ledger.record(found, book)
        return rows, sorted(set(map(os.path.basename, opened)))

    assert run() == ({"a": "new", "b": "new", "c": "new"}, [])  # the whole folder, the first time
    assert run() == ({}, [])
    (folder / "a").write_text("other")
    os.utime(folder / "b", (1, 1))
    (folder / "sub" / "c").unlink()
    (folder / "d").write_text("d")
    assert run() == ({"a": "changed", "b": "touched", "c": "gone", "d": "new"}, ["a", "b", "d"])
    assert run() == ({}, [])
    (folder / "e").write_text("e")
    assert [x.split("/")[0] + x[-1] for x in cli.run(spark, ["files", "--sources", str(folder), "--ledger", book])] == ["[new] file:e"]
    (folder / "e").unlink()
    assert run() == ({"e": "gone"}, [])
    assert {os.path.basename(r.path) for r in ledger.known(spark, book).collect()} == {"a", "b", "d"}


def test_json_objects_and_collections(spark, tmp_path):
    from lectern.sources import sinks

    (tmp_path / "a.json").write_text('{"a": 1,\n "b": ["x"]}')
    assert [tuple(r) for r in readers.json_object(spark, str(tmp_path / "a.json"), "a int, b array<string>").collect()] == [(1, ["x"])]
    (tmp_path / "bad.json").write_text("[1, 2")
    with pytest.raises(Exception):
        readers.json_object(spark, str(tmp_path / "bad.json"), "a int").collect()
    name = f"points_{os.getpid()}_{next(itertools.count())}"
    rows = spark.createDataFrame([(1,)], "a int").withColumn("b", F.lit("x"))
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    try:
        sinks.collection(rows, name)
        with pytest.raises(Exception, match="(?i)exists"):
            sinks.collection(rows, name)
        sinks.collection(rows.union(rows), name, recreate=True)
        assert spark.table(name).count() == 2
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_tables_deal_their_pages_once(spark):
    plan = registry.queries()["page_grids"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
