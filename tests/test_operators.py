import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking, headings, layout, retrieval, validate


def packed(tokens, most, overlap):
    """Sequential packing, atom by atom."""
    out, cur = [], []
    for i, t in enumerate(tokens):
        if cur and sum(tokens[j] for j in cur) + t > most:
            out.append((cur[0], cur[-1]))
            seed, total = [], 0
            for j in reversed(cur):
                if overlap <= 0 or total + tokens[j] > overlap:
                    break
                seed.insert(0, j)
                total += tokens[j]
            while seed and sum(tokens[j] for j in seed) + t > most:
                seed.pop(0)
            cur = seed
        cur = [*cur, i]
    if cur:
        out.append((cur[0], cur[-1]))
    return out


def test_pack_matches_sequential(spark):
    random.seed(5)
    cases = [[random.randint(1, 20) for _ in range(random.randint(1, 25))] for _ in range(150)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t array<bigint>")
    for most, over in ((20, 0), (20, 7), (50, 30)):
        got = df.select("i", chunking.pack(F.col("t"), most, over).alias("r")).orderBy("i").collect()
        assert [[(x.s, x.e) for x in r.r] for r in got] == [packed(c, most, over) for c in cases]


def test_profiles():
    assert chunking.resolve_profile("command_reference") == (250, 30, 25)
    assert chunking.resolve_profile("default", {"maximum_tokens": 300}, overlap=10) == (300, 10, 60)
    with pytest.raises(ValueError):
        chunking.resolve_profile("default", maximum=10, overlap=10)


def test_levels_and_paths(spark):
    rows = [("d", f"e{i}", f"t{i}", lv, i) for i, lv in enumerate([1, 3, 2, 3])]
    ev = headings.with_level_paths(headings.with_parents(spark.createDataFrame(rows, "document_id string, event_id string, title string, level int, anchor_index int")))
    got = {r.event_id: (r.parent_event_id, r.heading_path) for r in ev.collect()}
    assert got == {"e0": (None, ["t0"]), "e1": (None, ["t1"]), "e2": ("e0", ["t0", "t2"]), "e3": ("e2", ["t0", "t2", "t3"])}
    joined = {r.event_id: r.heading_path for r in headings.heading_paths(ev.drop("heading_path")).collect()}
    assert joined == {k: v[1] for k, v in got.items()}


def test_margin_threshold(spark):
    rows = [("d", p, 792.0, 0, 1, "Page 7 of Book" if p < 4 else f"text {'abc'[p % 3]}{p}", 30.0, 60.0) for p in range(20)]
    got = layout.repeated_margins(spark.createDataFrame(rows, "document_id string, page_number long, height double, block_index int, block_count int, text string, y0 double, y1 double")).collect()
    assert [(r.signature, r.pages) for r in got] == [("top:page <number> of book", 4)]


def test_diversify(spark):
    rows = [(1, "c1", "a", 1), (1, "c2", "a", 2), (1, "c3", "a", 3), (1, "c4", "b", 4), (1, "c5", None, 5), (1, "c6", None, 6), (1, "c7", None, 7)]
    hits = spark.createDataFrame(rows, "query_id int, chunk_id string, parent_id string, rank int")
    assert [r.chunk_id for r in retrieval.diversify(hits, top=3).orderBy("position").collect()] == ["c1", "c2", "c4"]
    assert [r.chunk_id for r in retrieval.diversify(hits).orderBy("position").collect()] == ["c1", "c2", "c4", "c5", "c6", "c7"]


def test_budget(spark):
    words = lambda n: " ".join(["w"] * n)
    df = spark.createDataFrame([(1, 1, words(100)), (1, 2, words(151)), (1, 3, words(5)), (2, 1, words(51)), (2, 2, words(200))], "query_id int, position int, text string")
    got = {(r.query_id, r.position): (r.truncated, r.token_count_approx) for r in retrieval.within_budget(df, 149).collect()}
    assert got == {(1, 1): (False, 100), (2, 1): (False, 51), (2, 2): (True, 98)}
    got = {(r.query_id, r.position): (r.truncated, r.token_count_approx) for r in retrieval.within_budget(df, 150).collect()}
    assert got[(1, 2)] == (True, 50) and (1, 3) not in got


def test_merge(spark):
    df = spark.createDataFrame([([["A", "B"], ["b", "C"], [], ["D"]],)], "p array<array<string>>")
    assert df.select(retrieval.merge_texts(F.col("p")).alias("t")).first().t == "A\n\nB\n\nC\n\nD"


def test_modes_and_validation(spark):
    hits = spark.createDataFrame([], "query_id int, position int, chunk_id string, parent_id string, document_id string, chunk_number int, page_start int, page_end int, text string")
    with pytest.raises(ValueError):
        retrieval.contexts(hits, hits, hits, "other")
    parents = spark.createDataFrame([("p",), ("p",), (None,)], "parent_id string")
    chunks = spark.createDataFrame([("c", "p", "t"), ("d", "q", " ")], "chunk_id string, parent_id string, text string")
    rules = sorted(r.rule for r in validate.violations(parents, chunks).collect())
    assert rules == ["chunk-without-text", "parent-id-twice", "parent-unknown", "parent-without-id"]
    with pytest.raises(validate.CorpusError):
        validate.validate(parents, chunks)


def test_line_and_code(spark):
    df = spark.createDataFrame([([("sudo ls", True), (" -la", False)],)], "s array<struct<text:string,is_monospaced:boolean>>")
    line = df.select(layout.line_fields(F.col("s")).alias("x")).first().x
    assert (line.text, line.monospaced_ratio, line.contains_command_pattern) == ("sudo ls -la", 0.6364, True)
    flags = spark.range(1).select(layout.span_fields(F.lit(0b11001)).alias("x")).first().x
    assert (flags.is_superscript, flags.is_italic, flags.is_monospaced, flags.is_bold) == (True, False, True, True)
