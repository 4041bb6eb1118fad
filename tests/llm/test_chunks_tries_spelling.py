"""SentencePiece encoding, the prefix trie and spelling variants against the library and brute force, on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import pieces, prefixes, registry, spelling
from lectern.llm.wavelet import Grid, Wavelet, code_points

D = "/root/testdata/sf0.001"
MODEL = registry.tokenizer_path("piece_bpe_32k.model")
random.seed(23)
PARTS = list("  ▁\n\tabcxyzäß中\U0001f600\0<>s/1290'") + ["the", "ing", " und", "<s>", "<0x41>", "<unk>", "�"]
AWKWARD = [None, "", " ", "  ", "▁", "a", " a", "a ", "x" * 5000, " " * 3000 + "x", "one two  three\n four"]
AWKWARD += ["".join(random.choice(PARTS) for _ in range(random.randrange(40))) for _ in range(3000)]
EXTRA = "doc_id long, text string, word string, n long, ids int, lang string"


def awkward(spark, texts):
    rows = [(i if i else None, t, "w", 1, 1, "en") for i, t in enumerate(texts)] + [(1, "again", None, None, None, None)] * 2
    return spark.createDataFrame(rows, EXTRA).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_encoding_equals_the_library(spark):
    model = pieces.load(MODEL)
    assert model.chunked
    docs = awkward(spark, AWKWARD)
    got = collections.Counter(tuple(r) for r in pieces.round_trip(docs, MODEL).collect())
    want = collections.Counter()
    for r in docs.collect():
        ids = model.model.encode(r.text or "")
        want[(r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(model.model.decode(ids)))] += 1
    assert got == want
    back = pieces.decode(pieces.encode(docs.filter("doc_id > 1"), MODEL), MODEL)
    assert {r.doc_id: r.text for r in back.collect()} == {i: (t or "").replace("▁", " ") for i, t in enumerate(AWKWARD) if i > 1}
    assert pieces.round_trip(docs.limit(0), MODEL).count() == 0


def test_encoding_without_chunks_and_with_small_tables(monkeypatch):
    texts = pa.array(AWKWARD, pa.string())
    model = pieces.SentencePieces(MODEL)
    ids, n = model.encode(texts)
    whole = pieces.SentencePieces(MODEL)
    whole.chunked = False
    assert all(np.array_equal(a, b) for a, b in zip(whole.encode(texts), (ids, n)))
    assert whole.decode(ids, n) == model.decode(ids, n)
    monkeypatch.setattr(pieces, "KEPT_CHUNKS", 50)
    small = pieces.SentencePieces(MODEL)
    for a in range(0, len(texts), 100):
        part = small.encode(texts.slice(a, 100))
        assert np.array_equal(part[1], n[a : a + 100]) and np.array_equal(part[0], ids[n[:a].sum() : n[: a + 100].sum()])


def test_decoding_of_any_ids():
    model = pieces.load(MODEL)
    for _ in range(2000):
        ids = [random.choice([random.randrange(32000), random.randrange(262)]) for _ in range(random.randrange(9))]
        assert model.decode(np.array(ids, np.int64), np.array([len(ids)])) == [model.model.decode(ids)]


def brute_trie(rows):
    turns = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
    members = collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    ends = {p: sorted(c for c in m if len(built[c]) == len(p)) for p, m in members.items()}
    up = lambda p: min(members[p[:-1]]) if p else None
    return collections.Counter((min(m), len(p), up(p), len(m), kids[p], leaves[p], saved[p], sha(",".join(map(str, ends[p])))) for p, m in members.items())


def conversations(spark):
    rows = []
    for c in [*range(500), None]:
        for t in range(random.choice([0, 1, 2, 2, 3, 9])):
            rows.append((c, random.choice([t, t, t, None]), random.choice(["u", "a", None]), random.choice(["x", "yy", "ä", None, ""])))
    rows += [(c, 0, "u", "hot") for c in range(1000, 1400)] + [(random.choice([3, 1005, 1100]), t, "u", f"deep{t}") for t in range(900)]
    rows += rows[:40]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"a": F.lit(1), "depth": F.lit("x")})


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_trie_equals_brute_force(spark, partitions):
    df = conversations(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = collections.Counter(tuple(r) for r in prefixes.trie(df).collect())
        assert prefixes.trie(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_trie([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_trie_of_turnless_conversations(spark):
    # conversation 1 borrows from none and has no turn behind the first h, 7 has one turn at least
    df = spark.createDataFrame([(1, 0, "u", "x"), (7, 0, "u", "y"), (7, 1, "a", "z")], "conv_id long, turn long, role string, text string")
    got = collections.Counter(tuple(r) for r in prefixes.trie(df).collect())
    assert got == brute_trie([tuple(r) for r in df.collect()]) and min(r[1] for r in got) == 0


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_wavelet_tree():
    for n in (1, 2, 5, 64, 100):
        values = np.random.default_rng(n).permutation(n)
        box = np.random.default_rng(n + 1).integers(0, n + 1, (60, 4))
        q, found = Wavelet(values).report(*box.T)
        want = {(i, v) for i, (lo, hi, a, b) in enumerate(box.tolist()) for v in values[lo:hi].tolist() if a <= v < b}
        assert len(q) == len(want) and set(zip(q.tolist(), found.tolist())) == want


def test_grid_reports_every_edit():
    words = sorted({"".join(random.choice("abä\U0001f600") for _ in range(6)) for _ in range(300)})
    short = sorted({w[:i] + w[i + 1 :] for w in words[:60] for i in range(6)} | {"bbbbb", "aaaaa"})
    grid, all_ = Grid(code_points(words, 6), code_points(short, 5)), words + short
    for first in (0, 3):
        got = {(all_[a], words[b]) for _, row, near in grid.edits(first) for a, b in zip(row.tolist(), near.tolist())}
        want = {(x, y) for x in words for y in words if x[:first] == y[:first] and one_edit(x, y)}
        want |= {(x, y) for x in short for y in words if any(y[:i] + y[i + 1 :] == x for i in range(first, 6))}
        assert got == want


def brute_spelling(rows):
    n = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) > 5 and k > 4}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def spelled(spark):
    stems = ["".join(random.choice("abcdeéß") for _ in range(random.randrange(6, 11))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "Straßen", "Éclairs", "éclairs"]
    words = []
    for s in stems:
        words += [s] * random.choice([5, 30, 200])
        for _ in range(4):
            i = random.randrange(len(s))
            words += [s[:i] + random.choice(["", "a", "zb"]) + s[i + random.choice([0, 1]) :]] * random.choice([5, 6, 40])
    words += ["common" + x for x in "abcdefghijklmnopqrst" for _ in range(6)] + ["y" * 3000] * 5 + ["y" * 2999 + "z"] * 30
    random.shuffle(words)
    texts = [None, "", "1 2 3"] + [", ".join(words[k : k + 50]) for k in range(0, len(words), 50)]
    rows = [(i if i != 5 else None, t, "word", 7, 1, "en") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[6:9], EXTRA).repartition(3)


@pytest.mark.parametrize("most", [None, 3, 12])
def test_variants_equal_brute_force(spark, most):
    docs = spelled(spark)
    got = [tuple(r) for r in spelling.variants(docs, most=most).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spelling([(r.doc_id, r.text) for r in docs.collect()])
    assert spelling.variants(docs.limit(0), most=most).count() == 0


def test_forms_may_not_lead_in_circles(spark):
    with pytest.raises(ValueError):
        spelling.variants(spelled(spark), times=1)


@pytest.mark.parametrize("name", ["op12_prefixes", "op13_spelling"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got = registry.queries()[name](spark, D)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(want)
