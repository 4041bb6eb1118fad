import re
import unicodedata
import uuid

from pyspark.sql import functions as F

from lectern.functions import text as T

TOKEN = re.compile(r"\w+|[^\w\s]")
SAMPLES = ["Hello, world!", "Sales grew 40%, year-over-year!", "", "  a\t b\n\nc ", "Straße É", "x" * 700, "one two three four five six seven", " soft­hyphen"]


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", make(F.col("t")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_tokens(spark):
    assert column(spark, SAMPLES, T.token_count) == [len(TOKEN.findall(s)) for s in SAMPLES]
    assert column(spark, ["Hello, world!", "Sales grew 40%, year-over-year!"], T.token_count) == [4, 11]


def test_split_and_truncate(spark):
    text = "one two three four five six seven"
    assert column(spark, [text], lambda c: T.split_tokens(c, 5)) == [["one two three four five", "six seven"]]
    assert column(spark, [text], lambda c: T.truncate_tokens(c, 3)) == ["one two three"]
    assert column(spark, [text, ""], lambda c: T.truncate_tokens(c, 0)) == ["", ""]


def test_hash_ignores_case_and_space(spark):
    a, b, c, d = column(spark, ["Hello   World", "hello world", "Straße", "STRASSE"], T.content_hash)
    assert a == b and c == d and a != c


def test_point_id(spark):
    got = column(spark, ["a/chunk-001", "é"], T.point_id)
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, T.POINT_PREFIX + s)) for s in ("a/chunk-001", "é")]


def test_titles(spark):
    assert column(spark, ["Chapter 3: The End"], T.title_variants) == [["Chapter 3: The End", "The End"]]
    assert column(spark, ["Table of Contents", "Foreword by X", "Results", "www.x"], T.is_indexable_title) == [False, False, True, False]
    assert column(spark, ["Ｆｕｌｌ Width!", "***", "a" * 80], T.slugify) == ["full-width", "section", "a" * 70]


def test_similarity():
    assert T.similarity(["Chapter 1: Intro", "Intro"], "INTRO") == 1.0
    assert T.similarity(["Intro"], "Intro part") >= 0.96
    assert T.similarity(["Intro"], "") == 0.0
    assert T.similarity(["Memory layout"], "Memory layouts in C", 0.6) == T.similarity(["Memory layout"], "Memory layouts in C")


def test_paragraphs_and_preview(spark):
    assert column(spark, ["a\n \nb\n\n\nc ", ""], T.split_paragraphs) == [["a", "b", "c"], []]
    assert column(spark, ["x" * 301, "x" * 300], T.preview) == ["x" * 297 + "...", "x" * 300]
    assert unicodedata.normalize("NFKC", "ﬁ") == column(spark, ["ﬁ"], T.nfkc)[0]


def test_white_space_is_what_the_pattern_takes(spark):
    rows = spark.range(1, 0x3100).select(F.decode(F.encode(F.expr("from_json(concat('[\"\\\\u', lpad(hex(id), 4, '0'), '\"]'), 'array<string>')[0]"), "UTF-8"), "UTF-8").alias("x"))
    rows = rows.select(F.concat("x", F.lit("a"), "x", "x", F.lit("b "), "x").alias("c")).filter("c IS NOT NULL")
    strip, spaces = F.regexp_replace("c", r"(?U)^\s+|\s+\z", ""), F.regexp_replace("c", r"(?U)\s+", " ")
    assert rows.count() > 12000
    assert rows.filter(~T.strip(F.col("c")).eqNullSafe(strip) | ~T.squeeze(F.col("c")).eqNullSafe(F.regexp_replace(spaces, "^ | $", ""))).count() == 0
    assert "regexp" not in rows.select(T.strip(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()


def test_similarity_equals_the_plain_matcher():
    from difflib import SequenceMatcher

    pairs = [("Chapter 3: Walking Nations", t) for t in ("walking nations", "nations walking far away from here", "", "CHAPTER 3 walking", "ﬁne ß")] + [("a", "ab"), ("abc", "cba abc")]
    for title, text in pairs:
        plain = lambda x: T._words(T._collapse(x))
        bare = lambda x: "".join(ch for ch in plain(x) if ch.isascii() and ch.isalnum())
        ratios = [SequenceMatcher(None, bare(title), bare(text)).ratio(), SequenceMatcher(None, plain(title), plain(text)).ratio()] if bare(text) else [0.0]
        full, cut = T.similarity([title], text), T.similarity([title], text, 0.6)
        assert full >= round(max(ratios), 4) and (cut == full or (cut < 0.6 and full < 0.6))
    T._forms.cache_clear()
    T.similarity(["one title"], "a text")
    T.similarity(["one title"], "a text")
    assert T._forms.cache_info().hits == 2
