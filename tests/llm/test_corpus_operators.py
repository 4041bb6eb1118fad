"""Each operator against brute force, an exact round trip, SQL or held-out accuracy, on awkward rows."""

import hashlib
import random
import re
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, jaccard, licenses, pii, quality, registry, rules, substrings, toxicity, warc
from lectern.llm.graph import components

D = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
random.seed(11)
VOCAB = [f"w{i}" for i in range(400)] + ["Straße", "ÉTÉ", "日本", "The", "the"]
BASE = [random.choice(VOCAB) for _ in range(300)]


def changed(words, n):
    out = list(words)
    for _ in range(n):
        out[random.randrange(len(out))] = random.choice(VOCAB)
    return out


TEXTS = [None, "", "   \n\t ", "one", "one two three", "One TWO three", "a\x0bb\x1cc d e f g", "x " * 3000, "same words here again and again"]
TEXTS += [" ".join(BASE)] * 3 + [" ".join(changed(BASE, k)) for k in (1, 2, 3, 5, 8, 10, 12, 14, 16, 20) for _ in range(3)]
TEXTS += [" ".join(random.choice(VOCAB) for _ in range(random.randrange(1, 200))) for _ in range(30)]
TEXTS += ["  ".join([*BASE[40:110], *(random.choice(VOCAB) for _ in range(80))]) for _ in range(15)]
ROWS = list(enumerate(TEXTS))
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, region string, b int, label int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"src{i % 3}" if i % 5 else None, len(t or ""), 1.0, "r", 1, 0) for i, t in ROWS]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


def sets(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute_components(rows):
    parent = {i: i for i, _ in rows}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    s = {i: sets(t) for i, t in rows}
    for a, b in combinations(s, 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in s}


FAMILY = [(1000 + k, " ".join(changed(BASE[:120], n))) for k, n in enumerate((2, 3, 4, 5, 7, 9, 12, 15, 20, 30) * 8)]


@pytest.mark.parametrize("small,block,leaf", [(8, 4 << 20, 64), (1, 4 << 20, 64), (1, 20_000, 1 << 30), (1, 20_000, 0), (1, 6_000, 2)])
def test_jaccard_equals_brute_force(spark, docs, monkeypatch, small, block, leaf):
    for name, value in (("SMALL_RUN", small), ("BLOCK_BYTES", block), ("SET_BYTES", 0 if block < 1 << 20 else 2048), ("LEAF_BLOCKS", leaf)):
        monkeypatch.setattr(jaccard, name, value)
    calls, split = [], jaccard.voronoi
    monkeypatch.setattr(jaccard, "voronoi", lambda *a: calls.append(1) or split(*a))
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(FAMILY, "doc_id long, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(rows).collect()}
    assert got == brute_components(ROWS + FAMILY)
    assert bool(calls) == (leaf < 64)


def test_jaccard_odd_ids(spark, empty):
    text = " ".join(BASE[:40])
    rows = [(None, text), (5, text), (5, text), (7, text + " x"), (5, "other words entirely " * 9), (9, "other words entirely " * 9), (3, None)]
    got = sorted(((r.doc_id or -1, r.component_id or -1) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(-1, -1), (3, 3), (5, 5), (5, 5), (5, 5), (7, 5), (9, 5)]
    assert jaccard.join(empty).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def brute_removal(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone, new = set(), []
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if key in seen:
                gone |= set(range(k, k + 50))
            new.append(key)
        seen |= set(new)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings_equal_brute_force(docs, empty, spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduplicate(docs).collect()}
    assert got == brute_removal(ROWS)
    assert substrings.deduplicate(empty).count() == 0
    text = " ".join(BASE[:80])
    odd = spark.createDataFrame([(None, text), (4, text), (4, text), (4, text + " y"), (6, "z " + text)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in substrings.deduplicate(odd).collect()) == [(-1, 0), (4, 0), (4, 0), (4, 0), (6, 80)]


def test_difference_cover():
    for d in range(substrings.PERIOD):
        assert any((c + d) % substrings.PERIOD in substrings.COVER for c in substrings.COVER)


def test_bpe_equals_library(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = registry.tokenizer_path()
    lib = tokenizers.Tokenizer.from_file(path)
    hard = ["", "aaaa<|endoftext|> b", " lead", "tail ", "two  spaces\n\n x", "don't 'LL 123４５ ½²", "😀👍🏽 é", "a" * 999, "\x00\x1c \x85"]
    own = bpe.load(path)
    hard += ["a \u2003b c", "x\x1c y", "it's they'll  go", "ſ ﬁ ǅ a.b c! d!? e., f", " ", "a<|endoftext|>"]
    ids, n = own.encode(pa.array(hard))
    at = 0
    for t, k in zip(hard, n):
        assert ids[at : at + k].tolist() == lib.encode(t, add_special_tokens=False).ids, t
        at += k
    for r in bpe.round_trip(docs, path).collect():
        t = TEXTS[r.doc_id] or ""
        e = lib.encode(t, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert back == {i: t or "" for i, t in ROWS}
    assert bpe.round_trip(empty, path).count() == 0


def semi_global(a, b):
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return min(prev)


def test_leaks_equal_brute_force(spark, docs, empty):
    items = [(1, " ".join(BASE[10:40])), (2, " ".join(changed(BASE[100:140], 4))), (3, "too short"), (4, None), (5, ""), (5, " ".join(BASE[50:60]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: [x for x in (re.sub(r"[\W_]+", "", w.lower()) for w in WORD.findall(t or "")) if x]
    want = set()
    for i, t in ROWS:
        for k, item in items:
            a = norm(item)
            if a and semi_global(a, norm(t)) <= int(decontaminate.RATE * len(a)):
                want.add((i, k, semi_global(a, norm(t))))
    got = decontaminate.leaks(docs, bench)
    assert {(r.doc_id, r.item_id, r.distance) for r in got.collect()} == want
    kept = {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()}
    assert kept == {i for i, _ in ROWS} - {w[0] for w in want}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_at_the_start_of_a_slice(spark):
    item = " ".join(f"p{i}" for i in range(20))
    for n in (1, 2, 3):
        docs = spark.createDataFrame([(1, " ".join(item.split()[n:]) + " and more")], "doc_id long, text string").coalesce(1)
        bench = spark.createDataFrame([(7, item)], "item_id long, text string")
        assert [(r.doc_id, r.item_id, r.distance, r.first_word) for r in decontaminate.leaks(docs, bench).collect()] == [(1, 7, n, 0)]
        assert decontaminate.decontaminate(docs, bench).count() == 0


def test_short_items_are_searched_exactly(spark):
    docs = spark.createDataFrame([(1, "say: the CAPITAL of France, is"), (2, "the capital of x France"), (3, "yes"), (4, "a b c d e f g and yes yes"), (5, "a b c d e f h"), (6, None), (7, "a b c d e x h")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, "The capital of France"), (2, "Yes!"), (3, "a b c d e f g"), (4, "?"), (5, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance, r.first_word, r.last_word) for r in decontaminate.leaks(docs, bench).collect())
    # seven words may have one edit at the rate of 0.15, six none
    assert got == [(1, 1, 0, 1, 4), (3, 2, 0, 0, 0), (4, 2, 0, 8, 8), (4, 3, 0, 0, 6), (5, 3, 1, 0, 5)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [2, 6, 7]


def test_scans_hold_their_own_blocks_only(spark, docs, monkeypatch):
    items = [(k, " ".join(BASE[a : a + n])) for k, (a, n) in enumerate([(0, 5), (10, 30), (40, 8), (60, 40), (100, 7), (120, 25), (150, 60), (220, 3), (230, 33)])]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    want = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    kept = sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect())
    live, most, send = set(), [], spark.sparkContext.broadcast
    destroy = decontaminate.Broadcast.destroy

    def sending(value):
        b = send(value)
        live.add(id(b))
        most.append((len(live), sum(map(len, value.items))))
        return b

    monkeypatch.setattr(spark.sparkContext, "broadcast", sending)
    monkeypatch.setattr(decontaminate.Broadcast, "destroy", lambda b, *a: live.discard(id(b)) or destroy(b, *a))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 50)
    monkeypatch.setattr(decontaminate, "SCAN_BLOCKS", 2)
    assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect())) == want and want
    assert len(most) > 2 and max(n for n, _ in most) <= 2 and max(w for _, w in most) < 2 * (50 + 60)
    live.clear()
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == kept and max(n for n, _ in most) <= 2


def test_repeated_hits_in_a_very_long_text(spark):
    item = " ".join(f"q{i % 9}" for i in range(27))
    text = " ".join(["w"] * 300 + (item.split()[:20] + ["z"]) * 400 + item.split())
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string").coalesce(1)
    got = decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.distance) for r in got] == [(1, 0)]


def against_sql(spark, frame, statement, **tables):
    import duckdb

    con = duckdb.connect()
    for name, df in tables.items():
        pdf = df.toArrow()
        con.register(name, pdf)
    cols = sorted(frame.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({statement})").fetchall()
    return sorted(map(repr, (tuple(r) for r in frame.select(cols).collect()))), sorted(map(repr, want))


def test_rules(spark, docs, empty):
    got, want = against_sql(spark, rules.judge(docs), rules.SQL, documents=docs.select("doc_id", "text", "source"))
    assert got == want and rules.judge(empty).count() == 0
    bad = spark.createDataFrame([(i, "few words", "bad") for i in range(9)] + [(i, " ".join(BASE[i : i + 30]), "good") for i in range(20, 60)] + [(99, " ".join(BASE[:40]), "bad")], "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in rules.judge(bad).collect()}
    assert not kept[99] and all(kept[i] for i in range(20, 60))
    # one host in twenty fails far more often than the prior of all hosts lets expect, though in less than half of its rows
    good = lambda k: " ".join(BASE[k % 90 : k % 90 + 30])
    rows = [(h * 100 + k, "few" if k < (18 if h == 7 else 2 + h % 3) else good(k), f"h{h}") for h in range(20) for k in range(50)]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, want = against_sql(spark, rules.judge(many), rules.SQL, documents=many)
    assert got == want
    verdict = {r.host: r.rejected for r in rules.host_verdicts(rules.measure(many)).collect()}
    assert {h for h, v in verdict.items() if v} == {"h7"}
    assert {r.doc_id // 100 for r in rules.judge(many).filter("NOT base_failed AND NOT kept").collect()} == {7}


def test_licenses(spark, docs, empty):
    notices = [(900, "x\nReleased under the MIT License!\nmore"), (901, licenses.TEMPLATES["MIT"]), (902, licenses.TEMPLATES["ISC"].replace("fee", "charge")), (903, "\nReleased under\nthe MIT License.\n\nother"), (904, "the license of this software")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(notices, "doc_id long, text string"))
    got, want = against_sql(spark, licenses.scan(both), licenses.sql(), documents=both)
    assert got == want
    names = {(r.doc_id, r.license) for r in licenses.scan(both).collect()}
    assert {(900, "MIT-notice"), (902, "ISC"), (903, "MIT-notice")} <= names and not any(i == 904 for i, _ in names)
    assert licenses.scan(empty).count() == 0


def test_licenses_in_published_layouts(spark):
    """Texts of several paragraphs, and notices that share their line with other words."""
    T = licenses.TEMPLATES
    mit = T["MIT"].replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    isc = T["ISC"].replace("copies. THE", "copies.\n\nTHE")
    apache = T["Apache-2.0-header"].replace("License. You", "License.\nYou").replace("at http", "at\n\n    http").replace("2.0 Unless", "2.0\n\nUnless")
    assert mit.count("\n\n") == isc.count("\n\n") + 1 == apache.count("\n\n") == 2
    top = "MIT License\n\nCopyright (c) 2020 Foo Bar\n\n"
    code = "\n\nimport os\nprint(os.name)"
    shared = "Copyright 2020 Foo. Licensed under the Apache License, Version 2.0."
    rows = [(1, mit), (2, top + mit + code), (3, isc), (4, apache), (5, "#!/bin/sh\n" + apache + code), (6, shared), (7, "x\nThis project is licensed under the MIT License and comes as it is"), (8, "Released under the MIT License."), (9, "a license\n\nof software"), (10, f"{shared}\n{shared}"), (None, mit), (8, "Released under the MIT License.")]
    got = sorted((r.doc_id or 0, r.unit, r.line, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    W = "window"
    assert got == [(0, W, 1, "MIT"), (1, W, 1, "MIT"), (2, W, 5, "MIT"), (3, W, 1, "ISC"), (4, W, 1, "Apache-2.0-header"), (5, W, 2, "Apache-2.0-header"), (6, W, 1, "Apache-2.0-notice"), (7, W, 2, "MIT-licensed"), (8, "line", 1, "MIT-notice"), (8, "line", 1, "MIT-notice"), (10, W, 1, "Apache-2.0-notice"), (10, W, 2, "Apache-2.0-notice")]


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_pii(spark, docs, empty):
    texts = ["card 4929963689861572.", "again 4929963689861572", "4929 9636 8986 1572", "no 5927243074273351", "+1 (551) 555-0826", "+1 (551) 555-0827", "ip 10.2.3.4 and 300.1.1.1", "2024-02-29 2023-02-30 31/12/1999", "a.07@mail8.example.com é", None, "", "123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.pseudonymise(df, "k").collect()}
    card = re.search(r"\d{16}", out[0]).group()
    assert card != "4929963689861572" and luhn(card) and card in out[1] and out[2].replace(" ", "") == card
    assert out[3] == texts[3] and out[9] is None and out[10] == ""
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[4]) and out[4] != texts[4] and out[4] != out[5]
    ip = re.match(r"ip (\d+)\.(\d+)\.(\d+)\.(\d+) and 300\.1\.1\.1", out[6])
    assert ip and all(int(x) < 256 for x in ip.groups()) and "10.2.3.4" not in out[6]
    assert "2023-02-30" in out[7] and "2024-02-29" not in out[7] and re.fullmatch(r"\d{4}-\d\d-\d\d 2023-02-30 \d\d/\d\d/\d{4}", out[7])
    assert "mail8" not in out[8] and out[8].endswith(" é") and "123-45-6789" not in out[11]
    assert {r.text for r in pii.pseudonymise(df, "other").collect()} != set(out.values())
    assert pii.pseudonymise(docs).columns == docs.columns and pii.pseudonymise(empty).count() == 0


def test_pii_beside_pii(spark):
    """Values next to values: each is replaced as it is when it stands alone."""
    alone = ["+1 (826) 555-4081", "+44 20 7946 0958", "190.137.223.204", "4929963689861572", "4929 9636 8986 1572", "123-45-6789", "2024-02-29", "555-123-4567", "a.07@mail8.example.com", "0123456789abcdef" * 2, "371449635398431"]
    numbers = ["12", "1235", "3.5"]
    joined = [(x, y) for x in alone for y in alone] + [(x, y) for x in alone for y in numbers if not x.startswith("+44")] + [(x, y) for x in numbers for y in alone]
    texts = alone + [" ".join(p) for p in joined]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]
    by = dict(zip(alone, out)) | {n: n for n in numbers}
    assert all(by[x] != x for x in alone)
    wrong = [(t, o) for (x, y), t, o in zip(joined, texts[len(alone) :], out[len(alone) :]) if o != f"{by[x]} {by[y]}"]
    assert not wrong, wrong


def test_pii_links_spellings_and_validates(spark):
    spellings = ["+1 (551) 555-0826", "+15515550826", "+1.551.555.0826", "+44 20 7946 0958", "+442079460958"]
    numbers = ["001-01-0001", "899-99-9999", "665-10-2000", "667-10-2000"]
    wrong = ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-3456", "123-45-0000"]
    df = spark.createDataFrame(list(enumerate(spellings + numbers + wrong)), "doc_id long, text string")
    out = [r.text for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]
    digits = [re.sub(r"\D", "", x) for x in out]
    assert len(set(digits[:3])) == 1 and digits[3] == digits[4] and digits[0][0] == "1" and digits[3][:2] == "44"
    for x in out[5:9]:
        assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x)
    assert len({*out[5:9], *numbers}) == 8 and out[9:] == wrong
    # without a key the session's own random one is used, the same for every stage
    assert [r.text for r in pii.pseudonymise(df).orderBy("doc_id").collect()] == [r.text for r in pii.pseudonymise(df, pii.session_key(spark)).orderBy("doc_id").collect()] != out


@pytest.mark.parametrize("left,right", [(3, 7), (16, 16), (5, 1)])
def test_feistel_is_a_permutation_of_pairs(spark, left, right):
    df = spark.range(left * right).select(pii.feistel(F.floor(F.col("id") / right), F.col("id") % right, F.lit(left), F.lit(right), "t", "k").alias("p"))
    got = {(r.p.l, r.p.r) for r in df.collect()}
    assert got == {(a, b) for a in range(left) for b in range(right)}


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    got = [r.p for r in df.select(pii.permute_digits(F.col("d"), "t", "k").alias("p")).collect()]
    assert len(set(got)) == 1000 and all(len(x) == 3 for x in got)


def test_warc(spark):
    big, small = "é" * 600, "tiny"
    rows = [(1, "http://a\r\nX: y", big), (2, "u", big), (9, None, big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""), (7, "u", "z" * 1000), (None, "u", "q" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got, want = against_sql(spark, warc.archive(pages), warc.SQL, pages=pages)
    assert got == want
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive(pages).collect()}
    assert kinds[1] == kinds[2] == ("revisit", 9) and kinds[9] == ("response", None) and kinds[3] == kinds[4] == ("response", None)
    assert warc.archive(pages.limit(0)).count() == 0


def test_warc_rebuilds_records(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "body " * 400) for i in range(600)], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == 1
    back = warc.read(spark, str(tmp_path / "a")).collect()
    assert len(back) == 600 and all(bytes(r.payload).decode() == "body " * 400 and bytes(r.header).startswith(b"WARC/1.1\r\n") for r in back)
    body = b"body " * 400
    digests = f"WARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}\r\nWARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nWARC-Payload-Length: 2000\r\nContent-Type: text/html; charset=utf-8\r\n"
    for r in back:
        kind, refers, block = ("response", "", body) if r.page_id == 599 else ("revisit", "WARC-Refers-To: <urn:page:599>\r\n", b"")
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{r.page_id}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: http://h/{r.page_id}\r\n{refers}{digests}Content-Length: {len(block)}\r\n\r\n"
        assert bytes(r.record) == head.encode() + block + b"\r\n\r\n"


def test_slashed_dates_stay_apart(spark):
    days = [f"{d:02d}/{m:02d}/{y}" for y in (1999, 2020) for m in range(1, 13) for d in range(1, 32)]
    df = spark.createDataFrame([(t,) for t in days], "t string").withColumn("p", pii.replace(F.col("t"), "k"))
    import datetime

    def known(t):
        out = set()
        for a, b in (("m", "d"), ("d", "m")):
            x = dict(zip((a, b, "y"), map(int, t.split("/"))))
            try:
                out.add((a, datetime.date(x["y"], x["m"], x["d"])))
            except ValueError:
                pass
        return out

    got = {r.t: r.p for r in df.collect()}
    real = [t for t in days if known(t)]
    assert len({got[t] for t in real}) == len(set(real)) and all(got[t] == t for t in days if not known(t))
    assert all(known(got[t]) for t in real)
    # what can only be day first stays so
    assert all(int(got[t][:2]) > 12 for t in real if int(t[:2]) > 12) and sum(got[t] != t for t in real) > 0.98 * len(real)


def test_padded_addresses(spark):
    texts = ["192.168.001.001", "192.168.1.1", "8.8.8.8", "010.000.000.001"]
    got = [r.p for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("p", pii.replace(F.col("t"), "k")).orderBy("k").collect()]
    assert [len(x) for x in (got[0], got[3])] == [15, 15] and [int(x) for x in got[0].split(".")] == [int(x) for x in got[1].split(".")] and got[2] != texts[2]


@pytest.mark.parametrize("name,column,sf", [("op6_quality", "quality", "0.01"), ("op4_toxicity", "toxic", "0.1")])
def test_classifiers_on_held_out_rows(spark, name, column, sf):
    # sf0.01 has only some 35 toxic training rows, too few to learn the words of three of the languages
    d, least = D.replace("0.001", sf), 0.95
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", column)
    rows = registry.queries()[name](spark, d).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r[column] for r in rows) >= least * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_equals_plain_discriminant(spark):
    """Scores against an independent discriminant that inverts the covariances."""
    import numpy as np

    rows = [(i, " ".join(changed(BASE[: 20 + i % 60], 3)) + (" ### | |" if i % 3 else "."), int(i % 3 == 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = {r.doc_id: (r.held_out, r.score) for r in quality.classify(df, df.select("doc_id", "label")).collect()}
    x = quality.features(pa.array([r[1] for r in rows]))
    y, train = np.array([r[2] for r in rows]), np.array([not got[r[0]][0] for r in rows])
    parts = [x[train & (y == k)] for k in (0, 1)]
    cov = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, cov)) / train.sum()
    pooled = 0.95 * pooled + 0.05 * np.diag(np.diag(pooled)) + 1e-3 * np.eye(x.shape[1])
    z = np.full(len(x), np.log(len(parts[1]) / len(parts[0])))
    for sign, p, c in zip((-1, 1), parts, cov):
        c = 0.9 * c + 0.1 * pooled
        d = x - p.mean(0)
        z += sign * -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1])
    assert np.allclose([got[r[0]][1] for r in rows], 1 / (1 + np.exp(-np.clip(z, -500, 500))), atol=1e-6)


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_classifiers_without_labels(spark, docs, empty, classify):
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in classify(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 0), (3, None)], "doc_id long, label int")
    assert {r.score for r in classify(docs, ones).collect()} == {1.0}
    assert classify(empty, ones).count() == 0


def test_toxic_context():
    lexicon = toxicity.Lexicon({"=idiot": 4.0})
    x = toxicity.features(pa.array(["You are an idiot.", "You are not an idiot.", "He said idiot.", "An idiot.", None, ""]), lexicon)
    mass, targeted, negated, reported = (x[:, toxicity.FEATURES.index(k)] for k in ("mass", "targeted", "negated", "reported"))
    assert targeted[0] > 0 and negated[1] > 0 and reported[2] > 0
    assert mass[0] > 0 and mass[3] > 0 and mass[1] == 0 and not x[4:, 1:6].any()


def plain_grammar(text, insults):
    """Accepted weights of a text by the grammar's definition, looking at positions instead of states."""
    near = lambda at, i, reach: any(0 < i - j <= reach for j in at)
    closed = {w: k for k, words in toxicity.CLOSED.items() for w in words.split()}
    total = dict.fromkeys(("direct", "targeted", "negated", "reported", "threat", "hits"), 0.0)
    clauses, clause = [], []
    for raw in text.lower().replace("\n", " ; ").split():
        clause.append(re.sub(r"^[\W_]+|[\W_]+$", "", raw))
        if raw[-1] in ".!?;":
            clauses.append(clause)
            clause = []
    for words in [*clauses, clause]:
        kinds = [toxicity.INSULT if w in insults and w not in closed else closed.get(w) for w in words]
        # the subject of a reporting verb is no target
        kinds = [None if k == toxicity.TARGET and kinds[i + 1 : i + 2] == [toxicity.REPORT] else k for i, k in enumerate(kinds)]
        at = {k: [i for i, x in enumerate(kinds) if x == k] for k in (*toxicity.CLOSED, toxicity.INSULT)}
        T, V, N, reach = at[toxicity.TARGET], at[toxicity.THREAT], at[toxicity.INSULT], toxicity.REACH
        threat = any(near(V, t, reach) for t in T) or (V[-1:] == [len(words) - 1] and near(T, V[-1], reach))
        if not N and not threat:
            continue
        aimed = threat or any(near(T, i, reach) for i in N) or any(near(N, t, reach) for t in T)
        negated, reported = (any(near(at[k], i, n) for i in N + V) for k, n in ((toxicity.NEGATION, 3), (toxicity.REPORT, 8)))
        w = sum(insults[words[i]] for i in N) + toxicity.THREAT_WEIGHT * threat
        total["hits"] += 1
        total["threat"] += toxicity.THREAT_WEIGHT * threat
        total["direct"] += w * (not negated and not reported)
        total["targeted"] += w * (aimed and not negated and not reported)
        total["negated"] += w * (negated and not reported)
        total["reported"] += w * reported
    return total


def test_grammar_equals_its_definition():
    import numpy as np

    words = ["you", "they", "kill", "hurt", "not", "said", "idiot", "fool", "the", "tree", "walks", "idiot.", "you;", "said:", "so\nthen"]
    texts = [" ".join(random.choice(words) for _ in range(random.randrange(0, 25))) for _ in range(400)]
    texts += ["I will kill you.", "An idiot.", "idiot you are.", "You idiot.", "beat the eggs and burn the sugar", "He said: you idiot."]
    insults = {"idiot": 4.0, "fool": 2.5}
    x = toxicity.features(pa.array(texts), toxicity.Lexicon({f"={k}": v for k, v in insults.items()}))
    at = toxicity.FEATURES.index
    want = [plain_grammar(t, insults) for t in texts]
    for name, key in (("mass", "direct"), ("targeted", "targeted"), ("negated", "negated"), ("reported", "reported"), ("threat", "threat"), ("hits", "hits")):
        assert np.allclose(x[:, at(name)], np.log1p([w[key] for w in want])), name
    assert x[-6, at("targeted")] > 0 and not x[-2, 1:6].any() and x[-1, at("reported")] > 0 and x[-1, at("mass")] == 0


def test_threats_need_a_target():
    texts = ["Burn the wood.", "Beat two eggs and stir.", "They left. Beat two eggs.", "I will burn you.", "You will burn.", "Ich werde dich töten.", "I will not hurt you.", "She said: kill.", "He wrote that I kill you."]
    x = toxicity.features(pa.array(texts), toxicity.Lexicon({"=idiot": 4.0}))
    at = toxicity.FEATURES.index
    carried = x[:, [at(k) for k in ("mass", "targeted", "negated", "reported", "threat", "clause", "hits")]]
    assert not carried[[0, 1, 2, 7]].any()
    assert (x[3:6, at("targeted")] > 0).all() and (x[3:6, at("threat")] > 0).all()
    assert x[6, at("negated")] > 0 and x[6, at("mass")] == 0
    assert x[8, at("reported")] > 0 and x[8, at("mass")] == 0


def test_subjects_are_no_targets():
    texts = ["They beat eggs.", "People burn candles.", "You can burn a CD.", "I will kill you.", "idiot you are", "The idiot left.", "You and your idiot."]
    x = toxicity.features(pa.array(texts), toxicity.Lexicon({"=idiot": 4.0}))
    at = toxicity.FEATURES.index
    assert not x[:3, at("threat")].any() and not x[:3, at("hits")].any() and x[3, at("threat")] > 0
    assert x[4, at("targeted")] > 0 and x[6, at("targeted")] > 0 and x[5, at("targeted")] == 0 and x[5, at("mass")] > 0


def test_repeated_labels_and_long_texts(spark):
    rows = [(i, "you utter slur " * (20_000 if i == 4 else 1) if i % 2 else "plain words here", i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = df.select("doc_id", "label")
    once, twice = (sorted(map(tuple, toxicity.classify(df, x).collect())) for x in (labels, labels.union(labels)))
    assert [r[3] for r in once] == [r[3] for r in twice] and toxicity.learn(df, labels) == toxicity.learn(df, labels.union(labels))


def test_small_family_of_insults_is_learned(spark):
    text = lambda i: f"w{i} " + ("of a common slur" if i % 75 else "of a raregroup slur")
    rows = [(i, text(i) if i < 1500 else f"w{i} of plain text", int(i < 1500)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    weight = toxicity.learn(df, df.select("doc_id", "label")).weight
    assert "=raregroup" in weight and "=slur" in weight
