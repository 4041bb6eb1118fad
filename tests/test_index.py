"""The index and its parts against brute force: terms, vectors, pruned search, updates, versions."""

import json
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern import cli
from lectern.functions import analysis
from lectern.operators import encoders, index, retrieval, vectors
from lectern.plans import registry
from lectern.sources import files, sinks

random.seed(3)
VOCAB = [f"{a}{b}" for a in ("walk", "nation", "Straß", "ciud", "écout", "box", "hop", "run", "class", "zz") for b in ("ing", "ed", "s", "es", "al", "ation", "en", "ung", "ez", "ado", "", "er", "ping", "ies")]
CHUNK = "chunk_id string, parent_id string, section_id string, document_id string, chunk_number int, title string, heading_path array<string>, text string, embedding_text string, content_hash string, page_start int, page_end int"


def plain_stem(word, name):
    own = analysis.LANGUAGES[name]
    if word in own.stops:
        return None
    for k, step in enumerate(own.steps, 1):
        for ending in sorted(step.endings.split(), key=len, reverse=True):
            left = word[: -len(ending)]
            if word.endswith(ending) and len(left) >= step.least and re.search(f"{step.behind}$", left):
                word = left + step.replacement
                break
        if k == own.undouble_after and word[-2:] in own.doubled.split():
            word = word[:-1]
    return word.translate(str.maketrans(own.marked, own.plain))


@pytest.mark.parametrize("name", sorted(analysis.LANGUAGES))
def test_terms_equal_a_plain_stemmer(spark, name):
    own = analysis.LANGUAGES[name]
    words = [w.lower().replace("ß", "ss") for w in VOCAB] + sorted(own.stops) + [p + e for step in own.steps for e in step.endings.split() for p in ("", "a", "bcd", "nott", "prüf")]
    got = spark.createDataFrame([(" ".join(words),)], "t string").select(analysis.terms(F.col("t"), name)).first()[0]
    want = [s for w in words if (s := plain_stem(w, name)) is not None]
    assert got == want
    odd = spark.createDataFrame([(None,), ("",), ("... !",)], "t string").select(analysis.terms(F.col("t"), name).alias("x")).collect()
    assert [r.x for r in odd] == [None, [], []]


def test_terms_of_known_words(spark):
    said = {"english": ("The cities' running boxes hopped; national classes", "city run box hop nation class"), "german": ("die Prüfungen der Häuser", "pruf haus"), "spanish": ("las naciones rápidamente", "nacion rap"), None: ("The Cities", "the cities")}
    for name, (text, want) in said.items():
        got = spark.createDataFrame([(text,)], "t string").select(analysis.terms(F.col("t"), name)).first()[0]
        assert got == want.split(), name
    with pytest.raises(ValueError, match="unknown language"):
        analysis.terms(F.lit("x"), "latin")


def exact(points, asked, limit, key=str):
    out = []
    for q, x in asked:
        scored = sorted(((-round(float(np.dot(x, v)), 9), k) for k, v in points if v is not None), key=lambda t: (t[0], t[1]))
        out += [(q, k, rank) for rank, (_, k) in enumerate(scored[:limit], 1)]
    return sorted(out)


def unit(rng, n, dim=6):
    x = rng.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()


@pytest.mark.parametrize("few", [True, False])
def test_vectors_equal_brute_force(spark, monkeypatch, few):
    rng = np.random.default_rng(2)
    x = unit(rng, 500) + [[0.0] * 6] * 3
    x[100:180] = [x[0]] * 80  # repeats: ties go by key
    points = [(f"k{i:03d}", v) for i, v in enumerate(x)] + [("none", None)]
    asked = list(enumerate(unit(rng, 20) + [x[0]]))
    monkeypatch.setattr(vectors, "BLOCK", 37)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vectors, "HELD", 300)
    monkeypatch.setattr(vectors, "SENT", 100 if few else 3)
    rows = spark.createDataFrame([(k, 0, v) for k, v in points], "key string, tag int, embedding array<double>").repartition(5)
    queries = spark.createDataFrame(asked + [(99, None)], "query_id long, embedding array<double>").repartition(2)
    centre, _ = vectors.centroids(rows, 503, 6, 9)
    blocks = vectors.pack(vectors.with_cells(rows, centre))
    want = exact(points, asked, 7)
    ranked = lambda asked: sorted((r.query_id, r.key, r["rank"]) for r in retrieval.ranked(vectors.nearest(blocks, asked, 7, "key", vectors.few(queries)), "key", 7).collect())
    assert ranked(vectors.everywhere(queries, 9)) == want == ranked(vectors.aimed(queries, centre, 9))
    assert {r.key for r in vectors.unpack(blocks).collect()} == {k for k, v in points if v is not None}
    assert blocks.selectExpr("max(size(keys)) AS n").first().n <= 37
    got = retrieval.dense(rows, queries, "key", 7).collect()
    assert sorted((r.query_id, r.key, r["rank"]) for r in got) == want
    assert retrieval.dense(rows.limit(0), queries, "key").count() == retrieval.dense(rows, queries.limit(0), "key").count() == 0


def test_clustered_vectors_need_few_cells(spark):
    rng = np.random.default_rng(4)
    middle = np.array(unit(rng, 20, 16))
    x = middle[rng.integers(0, 20, 3000)] + 0.03 * rng.normal(size=(3000, 16))
    rows = spark.createDataFrame([(i, 0, v) for i, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).tolist())], "key long, tag int, embedding array<double>")
    centre, probes = vectors.centroids(rows, 3000, 16)
    asked = rows.filter("key % 50 = 0").select(F.col("key").alias("query_id"), "embedding")
    blocks = vectors.pack(vectors.with_cells(rows, centre))
    top = lambda aimed: {(r.query_id, r.key) for r in retrieval.ranked(vectors.nearest(blocks, aimed, 30, "key", True), "key", 30).collect()}
    exact = top(vectors.everywhere(asked, len(centre)))
    assert probes < len(centre) / 3 and len(exact & top(vectors.aimed(asked, centre, probes))) >= 0.9 * len(exact)


def test_recall_of_the_suggested_cells(spark):
    got = registry.queries()["vector_recall"](spark, "/root/testdata/sf0.001").agg(F.sum("found").alias("f"), F.sum("wanted").alias("w")).first()
    assert got.f >= 0.9 * got.w


def chunk(i, text, doc=None, n=0):
    doc = doc or f"d{i % 7}"
    return (f"{doc}/{i:04d}", f"{doc}/p", f"{doc}/s", doc, n or i, "Title" if i % 3 else None, ["A", "B"] if i % 2 else [], text, text, str(hash(text)), 1, 2)


def corpus(spark, n=400, start=0):
    rare = [f"rare{k}" for k in range(40)]
    text = lambda i: " ".join(random.choices(VOCAB, k=random.randrange(1, 40)) + random.choices(rare, k=i % 3) + ["common"] * (i % 11))
    return [chunk(i, text(i)) for i in range(start, start + n)]


QUERIES = [(1, "common walking rare3"), (2, "rare5 rare6 rare7"), (3, "nation"), (4, "nothing here"), (5, ""), (6, "common common ran box"), (7, "zz " + " ".join(VOCAB[:30]))]


def shown(df):
    return sorted((r.query_id, r.chunk_id, r["rank"], r.score) for r in df.collect())


@pytest.fixture
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id long, text string")


def plain_search(chunks, asked, language=None, limit=30):
    texts = index.lexical(chunks)
    return shown(retrieval.bm25(retrieval.postings(texts, "chunk_id", language=language), asked, "chunk_id", retrieval.sizes(texts), limit, language=language))


@pytest.mark.parametrize("language", [None, "english"])
def test_pruned_search_equals_exhaustive(spark, tmp_path, monkeypatch, asked, language):
    monkeypatch.setattr(index, "RANGE", 4)
    chunks = spark.createDataFrame(corpus(spark), CHUNK)
    index.build(chunks, str(tmp_path / "i"), language=language, slots=16)
    own = index.Index(spark, str(tmp_path / "i"))
    for limit in (3, 30):
        want = plain_search(chunks, asked, language, limit)
        assert shown(own.spoken(asked, limit)) == want == shown(own.spoken(asked, limit, pruned=False))
    some = asked.filter("query_id IN (1, 6)")
    assert own.candidates(some, 3).count() < own.candidates(some, 3, pruned=False).count() / 2
    # terms and ranges by join instead of literals
    monkeypatch.setattr(index, "LITERALS", 1)
    assert shown(own.spoken(asked, 3)) == plain_search(chunks, asked, language, 3)


def scanned(df, table):
    """Files and rows that the scan of a table read, from the plan that ran."""
    df.collect()
    stack, out = [df._jdf.queryExecution().executedPlan()], []
    while stack:
        node = stack.pop()
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        if name.endswith("QueryStageExec"):
            stack.append(node.plan())
        if name == "FileSourceScanExec" and f"/{table}/" in node.relation().location().rootPaths().mkString(","):
            out.append((node.metrics().apply("numFiles").value(), node.metrics().apply("numOutputRows").value()))
    return out


def test_search_reads_a_small_part(spark, tmp_path, asked):
    index.build(spark.createDataFrame(corpus(spark), CHUNK), str(tmp_path / "i"), slots=32)
    own = index.Index(spark, str(tmp_path / "i"))
    rare = asked.filter("query_id = 2")
    total = len(own._table("postings").inputFiles())
    (read, rows), *more = scanned(own.candidates(rare), "postings")
    assert not more and total >= 30 and read <= total / 8
    # cells that are not probed are not opened
    probe = index.hashed_terms(rare, "query_id", "text")
    cells = len(own._table("vectors").inputFiles())
    ((read, _),) = scanned(own.near(probe, probes=1), "vectors")
    assert cells >= 4 and read == 1


def test_updates_equal_a_rebuild(spark, tmp_path, asked):
    first, path = corpus(spark, 150), str(tmp_path / "i")
    index.build(spark.createDataFrame(first, CHUNK), path, slots=4, language="english")
    changed = [chunk(i, f"common rare{i % 40} changed text") for i in range(0, 60, 2)]
    fresh = corpus(spark, 40, 500)
    removed = spark.createDataFrame([(first[i][0],) for i in (1, 3, 70)] + [("unknown",), (changed[0][0],)], "chunk_id string")
    for _ in range(2):  # the second time nothing changes
        index.update(spark.createDataFrame(changed + fresh + first[100:110], CHUNK), path, removed=removed)
    keys = {c[0] for c in changed} | {first[i][0] for i in (1, 3, 70)}
    now = [c for c in first if c[0] not in keys] + changed + fresh
    again = [chunk(500, "rare1 once more")]
    index.update(spark.createDataFrame(again, CHUNK), path)
    now = [c for c in now if c[0] != again[0][0]] + again
    index.build(spark.createDataFrame(now, CHUNK), str(tmp_path / "new"), slots=4, language="english")
    grown, new = index.Index(spark, path), index.Index(spark, str(tmp_path / "new"))
    facts = lambda i: (i.n, i.average, i.points.count(), sorted(map(tuple, i._terms().collect())))
    assert facts(grown) == facts(new) and grown.n == len(now)
    want = shown(new.search(asked))
    assert shown(grown.search(asked)) == want and shown(grown.spoken(asked, 5)) == shown(new.spoken(asked, 5))
    only = F.col("document_id").isin("d1", "d2")
    assert shown(grown.search(asked, document=only)) == shown(new.search(asked, document=only))
    old = index.Index(spark, path)
    index.compact(path, spark)
    assert shown(old.search(asked)) == want  # a reader keeps the version it began with
    assert index.vacuum(path, spark) and not index.vacuum(path, spark)
    folded = index.Index(spark, path)
    assert len(folded.manifest["segments"]) == 1 and facts(folded) == facts(new) and shown(folded.search(asked)) == want


def test_failed_runs_leave_the_index(spark, tmp_path, asked, monkeypatch):
    path, chunks = str(tmp_path / "i"), spark.createDataFrame(corpus(spark, 60), CHUNK)
    index.build(chunks, path, slots=4)
    want = shown(index.Index(spark, path).search(asked))
    reader = index.Index(spark, path)

    def broken(texts, key, text):
        raise RuntimeError("no model")

    for run in (lambda: index.build(chunks.limit(5), path, broken, recreate=True), lambda: index.update(chunks.withColumns({"text": F.lit("x"), "content_hash": F.lit("y")}), path, broken)):
        with pytest.raises(RuntimeError, match="no model"):
            run()
        assert shown(index.Index(spark, path).search(asked)) == want == shown(reader.search(asked))
    with pytest.raises(index.StoreError, match="exists"):
        index.build(chunks, path)
    with pytest.raises(index.StoreError, match="no index"):
        index.Index(spark, str(tmp_path / "other"))
    index.build(chunks.limit(5), path, recreate=True)
    assert index.Index(spark, path).n == 5 and shown(reader.search(asked)) == want


def test_empty_index(spark, tmp_path, asked):
    path, none = str(tmp_path / "i"), spark.createDataFrame([], CHUNK)
    index.build(none, path, slots=2)
    assert index.Index(spark, path).search(asked).count() == 0
    index.update(spark.createDataFrame(corpus(spark, 20), CHUNK), path)
    assert index.Index(spark, path).search(asked).count() > 0
    index.update(none, path, removed=index.Index(spark, path).points.select("chunk_id"))
    assert index.Index(spark, path).n == 0 and index.Index(spark, path).search(asked).count() == 0


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "books")
    index.build(spark.createDataFrame(corpus(spark, 30), CHUNK), path, language="german", facts={"parent_count": 7, "processed_root": "here"})
    told = index.described(spark, path)
    assert set(told) >= {"schema_version", "created_at", "collection_name", "dense_model", "dense_dimension", "sparse_model", "bm25_language", "bm25_average_document_length", "distance", "fusion", "dense_vector_name", "sparse_vector_name", "document_ids", "chunk_count", "parent_count", "processed_root", "store_mode", "store_path", "store_url"}
    assert (told["collection_name"], told["bm25_language"], told["dense_dimension"], told["chunk_count"], told["parent_count"]) == ("books", "german", 64, 30, 7)
    assert told["document_ids"] == [f"d{k}" for k in range(7)] and index.Index(spark, path).language == "german"


def test_vectors_from_a_table(spark, tmp_path):
    chunks = spark.createDataFrame(corpus(spark, 20), CHUNK)
    known = chunks.filter("chunk_number < 15").select("chunk_id", F.array(F.lit(1.0), F.col("chunk_number").cast("double")).alias("embedding"))
    index.build(chunks, str(tmp_path / "i"), index.from_table(known), slots=2, cells=3)
    own = index.Index(spark, str(tmp_path / "i"))
    probe = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, embedding array<double>")
    assert [r.chunk_id[-4:] for r in own.near(probe, 2).orderBy("rank").collect()] == ["0014", "0013"] and own.embeddings.count() == 14 + 1
    with pytest.raises(index.StoreError, match="places"):
        index.update(spark.createDataFrame(corpus(spark, 5, 900), CHUNK), str(tmp_path / "i"))


def test_one_json_file(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a.json")
    row = spark.createDataFrame([(1, None, ["x", "ü"])], "a int, b string, c array<string>")
    sinks.json_document(row, path)
    assert json.loads((tmp_path / "a.json").read_text()) == {"a": 1, "b": None, "c": ["x", "ü"]}
    with pytest.raises(ValueError, match="one record"):
        sinks.json_document(row.union(row), path)

    class Broken(bytearray):
        def __init__(self, *_):
            raise OSError("disk full")

    monkeypatch.setattr(files, "bytearray", Broken, raising=False)
    with pytest.raises(OSError, match="disk full"):
        sinks.json_document(row.withColumn("a", F.lit(2)), path)
    monkeypatch.undo()
    assert json.loads(files.read_text(spark, path))["a"] == 1 and [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["a.json"]


def test_command_line_of_the_index(spark, tmp_path):
    rows = corpus(spark, 30)
    spark.createDataFrame(rows, CHUNK).write.parquet(str(tmp_path / "p" / "chunks"))
    parents = [(f"d{k}/p", "all of it", 1, 9) for k in range(7)]
    spark.createDataFrame(parents, "parent_id string, text string, page_start int, page_end int").write.parquet(str(tmp_path / "p" / "parents"))
    where = ["--processed", str(tmp_path / "p"), "--index", str(tmp_path / "i")]
    assert cli.run(spark, ["index", *where, "--bm25-language", "spanish"]) == ["Chunks: 30, parents: 7, documents: 7"]
    spark.createDataFrame([chunk(3, "brandnew words"), *rows[5:]], CHUNK).write.mode("overwrite").parquet(str(tmp_path / "p" / "chunks"))
    assert cli.run(spark, ["index", *where, "--update", "--compact"]) == ["Chunks: 26, parents: 7, documents: 7"]
    said = [json.loads(x) for x in cli.run(spark, ["search", *where, "--query", "brandnew", "--query", "xyzzy", "--json", "--context-mode", "child"])]
    assert [x["query"] for x in said] == ["brandnew", "xyzzy"] and said[0]["hits"][0]["chunk_id"] == "d3/0003"
    assert said[0]["retrieval"]["bm25_language"] == "spanish" and said[0]["contexts"][0]["text"] == "brandnew words"


TOPICS = {"sea": "boat wave salt harbour anchor tide", "wood": "tree bark leaf root forest moss", "city": "street tram market bridge tower square"}


def topical(n=240):
    random.seed(12)
    return [(i, topic := list(TOPICS)[i % 3], " ".join(random.choices(TOPICS[topic].split(), k=8) + random.choices(["and", "the", "of"], k=4))) for i in range(n)]


def test_projection_finds_topics(spark, tmp_path):
    rows = topical()
    docs = spark.createDataFrame(rows, "key long, topic string, text string").repartition(4)
    model = encoders.fit(docs, "key", "text", dimension=8, batch=7)
    again = encoders.fit(docs.repartition(3), "key", "text", dimension=8, batch=7)
    assert np.allclose(model.axes, again.axes) and np.array_equal(model.weight, again.weight)
    asked = spark.createDataFrame([(1, "tide boat"), (2, "moss, moss; LEAF"), (3, ""), (4, None), (5, "unheard")], "query_id long, text string")
    vectors_ = {r.query_id: np.array(r.embedding) for r in model.queries(asked, "query_id", "text").collect()}
    assert all(not vectors_[k].any() for k in (3, 4, 5)) and np.isclose(np.linalg.norm(vectors_[1]), 1)
    near = retrieval.dense(model.documents(docs, "key", "text"), model.queries(asked.filter("query_id < 3"), "query_id", "text"), "key", 40).collect()
    topic = {r[0]: r[1] for r in rows}
    assert {topic[r.key] for r in near if r.query_id == 1} == {"sea"} and {topic[r.key] for r in near if r.query_id == 2} == {"wood"}
    model.save(spark, str(tmp_path / "m"))
    loaded = encoders.load(spark, str(tmp_path / "m"), batch=1000)
    texts = docs.filter("key < 50")
    shown_ = lambda m: [(r.key, [round(v, 12) for v in r.embedding]) for r in m.documents(texts, "key", "text").orderBy("key").collect()]
    assert shown_(loaded) == shown_(model)
    none = encoders.fit(docs.limit(0), "key", "text", dimension=8)
    assert not none.documents(texts, "key", "text").filter("exists(embedding, v -> v <> 0)").count() and none.documents(docs.limit(0), "key", "text").count() == 0


def test_index_with_a_model_of_two_entry_points(spark, tmp_path):
    rows = [chunk(i, text) for i, _, text in topical(60)]
    chunks = spark.createDataFrame(rows, CHUNK)
    model = encoders.fit(chunks, "chunk_id", "text", dimension=8)
    index.build(chunks, str(tmp_path / "i"), model.documents, slots=2)
    own = index.Index(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "anchor")], "query_id long, text string")
    assert index.described(spark, str(tmp_path / "i"))["dense_model"] == "latent-terms" and own.manifest["dimension"] == 8
    hits = own.search(asked, model.queries, top=8, per_parent=8).collect()
    assert len(hits) == 8 and all(set(h.text.split()) & set(TOPICS["sea"].split()) for h in hits)


def test_a_build_encodes_each_chunk_once(spark, tmp_path):
    """The sample, the ranges and the cells read what the encoder gave, they do not call for it again."""
    seen = spark.sparkContext.accumulator(0)

    def counting(texts, key, text):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        plain = index.hashed_terms(texts, key, text)
        return plain.mapInArrow(run, plain.schema)

    index.build(spark.createDataFrame(corpus(spark, 60), CHUNK), str(tmp_path / "i"), counting, slots=2, cells=3)
    assert seen.value == 60 and index.Index(spark, str(tmp_path / "i")).embeddings.count() == 60


def test_postings_are_counted_where_the_words_are(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["é", "e", "é", "z", "z", "z"])], "k int, w array<string>")
    made = rows.select("k", retrieval.counted(F.col("w")).alias("c"))
    got = {r.k: [tuple(x) for x in r.c] for r in made.collect()}
    assert got == {1: [("a", 1), ("b", 2)], 2: [], 3: [], 4: [("e", 1), ("z", 3), ("é", 2)]}
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString().replace("AdaptiveSparkPlan", "")


def test_manifest_query_has_all_documents(spark, monkeypatch):
    monkeypatch.setattr(index, "LISTED", 3)
    row = registry.queries()["index_manifest"](spark, "/root/testdata/sf0.001").first()
    ids = row.document_ids.split(",")
    assert len(ids) == row.document_count > 3 and ids == sorted(set(ids))


def test_postings_are_packed_by_term_and_range(spark, tmp_path):
    chunks = spark.createDataFrame(corpus(spark, 60), CHUNK).coalesce(1)
    index.build(chunks, str(tmp_path / "i"), slots=2, cells=2)
    own = index.Index(spark, str(tmp_path / "i"))
    packed = own._table("postings")
    assert packed.count() == packed.select("term", "range").distinct().count() < own.postings.count()
    plain = retrieval.postings(index.lexical(chunks), "chunk_id")
    rows = lambda df: sorted((r.chunk_id, r.term, r.tf, r.length) for r in df.collect())
    assert rows(own.postings) == rows(plain)


def test_a_build_deals_no_texts_and_small_postings(spark, tmp_path, monkeypatch):
    """Ranges are chunks as they lie; postings carry neither lengths nor what follows from their lists; bounds are no table of their own."""
    dealt = []
    plain = type(spark.range(1)).repartitionById
    monkeypatch.setattr(type(spark.range(1)), "repartitionById", lambda rows, *a: (dealt.append(rows.columns), plain(rows, *a))[1])
    monkeypatch.setattr(index, "RANGE", 7)
    chunks = spark.createDataFrame(corpus(spark, 60), CHUNK).repartition(3)
    index.build(chunks, str(tmp_path / "i"), slots=2, cells=2)
    own = index.Index(spark, str(tmp_path / "i"))
    assert dealt == [["term", "range", "places", "tfs", "least_length", "best_tf", "best_length", "slot"]]
    assert not os.path.exists(tmp_path / "i/blocks")
    assert own.points.groupBy("range").count().selectExpr("max(count) AS n").first().n <= 7
    assert own.points.select("range", "place").distinct().count() == 60
    rows = lambda df: sorted((r.chunk_id, r.term, r.tf, r.length) for r in df.collect())
    assert rows(own.postings) == rows(retrieval.postings(index.lexical(chunks), "chunk_id"))


def test_compacting_reads_vectors_and_encodes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    rows = corpus(spark, 40)
    index.build(spark.createDataFrame(rows[:20], CHUNK), path, slots=2, cells=2)
    index.update(spark.createDataFrame(rows[20:], CHUNK), path)
    vectors_ = lambda: sorted((r.chunk_id, r.document_id, tuple(r.embedding)) for r in index.Index(spark, path).embeddings.collect())
    before = vectors_()
    dealt = []
    monkeypatch.setattr(index, "from_table", lambda *a: dealt.append(a))
    index.compact(path, spark)
    assert vectors_() == before and len(before) == 40 and not dealt


def test_kept_chunks_come_back_whole(spark):
    rows = spark.createDataFrame([("a", "T", "Title: x\n\nT"), ("b", "été", "été"), ("c", "x", "other"), ("d", "x", "")], "chunk_id string, text string, embedding_text string")
    assert sorted(registry._kept(rows).collect()) == sorted(rows.collect())


@pytest.mark.parametrize("literals", [5000, 1])
def test_stemmed_postings_of_asked_terms(spark, monkeypatch, literals):
    """Only words that become asked terms leave their texts; counts and lengths are those of all postings."""
    monkeypatch.setattr(retrieval, "LITERALS", literals)
    texts = spark.createDataFrame([(1, "The walks, walking; nation nations"), (2, "walked the boxes"), (3, ""), (4, None), (5, "the of"), (6, "other words")], "k int, text string")
    asked = spark.createDataFrame([("walk",), ("nation",), ("absent",), ("walk",)], "term string")
    rows = lambda df: sorted((r.k, r.term, r.tf, r.length) for r in df.collect())
    every = retrieval.postings(texts, "k", language="english")
    want = rows(every.join(asked.distinct(), "term", "left_semi"))
    some = retrieval.postings(texts, "k", among=asked, language="english")
    assert rows(some) == want == [(1, "nation", 2, 4), (1, "walk", 2, 4), (2, "walk", 1, 2)]
    # one pattern for each step and distinct word: none in the plan that reads the texts
    assert "regexp_replace" not in some._jdf.queryExecution().executedPlan().toString()


def test_full_searches_send_queries_once_and_fill_blocks(spark, monkeypatch):
    """Blocks are cut by cell only; each query goes out once, not for each cell, and the hits are those of joins by cell."""
    run = lambda: sorted(map(tuple, registry.queries()["vector_topk"](spark, "/root/testdata/sf0.001").collect()))
    sent, plain = [], vectors.everywhere
    monkeypatch.setattr(vectors, "everywhere", lambda queries, cells: (sent.append(cells), plain(queries, cells))[1])
    once = run()
    monkeypatch.setattr(vectors, "SENT_ONCE", 1)
    assert once == run() and once and sent[0] is None and sent[1] > 1
    blocks, centre, _ = registry._celled(spark, "/root/testdata/sf0.001")
    sizes = blocks.selectExpr("cell", "size(keys) AS n").collect()
    assert sum(r.n for r in sizes) == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert len(sizes) <= len(centre) + 4


def test_index_report_keeps_no_texts(spark, monkeypatch):
    """Counts are those of the parents and chunks themselves; what is kept for them has no texts."""
    kept, plain = [], registry.stage
    monkeypatch.setattr(registry, "stage", lambda rows, by=None: (kept.append((by, rows.columns)), plain(rows, by))[1])
    row = registry.queries()["index_report"](spark, "/root/testdata/sf0.001").first()
    assert [columns for by, columns in kept if by is None] == [["document_id", "words"]]
    c = registry.Corpus(spark, "/root/testdata/sf0.001")
    chunks = c.chunks
    assert (row.parent_count, row.chunk_count) == (c.parents.count(), chunks.count())
    texts = chunks.select(retrieval.lexical_text(F.col("title"), F.col("heading_path"), F.col("text")).alias("text"))
    assert row.average_lexical_length == round(retrieval.average_length(texts).first().avg_length, 4)


@pytest.mark.parametrize("pairs", [1 << 19, 1])
def test_filtered_searches_hand_on_the_best_of_each_task(spark, tmp_path, asked, monkeypatch, pairs):
    """Rows that are ranked are those of the tasks' best, not one for each query and chunk."""
    monkeypatch.setattr(index, "RANGE", 16)
    monkeypatch.setattr(index, "PAIRS", pairs)
    chunks = spark.createDataFrame(corpus(spark) + [chunk(i, "common copy of itself") for i in range(900, 960)], CHUNK).repartition(3)
    index.build(chunks, str(tmp_path / "i"), slots=4, cells=2)
    own = index.Index(spark, str(tmp_path / "i"))
    met, plain = [], retrieval.ranked
    monkeypatch.setattr(retrieval, "ranked", lambda scored, key, limit: (met.append(scored.count()), plain(scored, key, limit))[1])
    found = shown(own.spoken(asked, 3, document=F.col("document_id") != "d3"))
    monkeypatch.setattr(retrieval, "ranked", plain)
    texts = index.lexical(chunks)
    every = retrieval.bm25(retrieval.postings(texts, "chunk_id"), asked, "chunk_id", retrieval.sizes(texts), 1000).filter("chunk_id NOT LIKE 'd3/%'")
    assert found == shown(every.drop("rank").transform(lambda rows: plain(rows, "chunk_id", 3)))
    if pairs > 1:
        assert met[0] <= 3 * len(QUERIES) * 4


def test_contexts_search_once_and_send_few_hits(spark, tmp_path, asked, monkeypatch):
    index.build(spark.createDataFrame(corpus(spark), CHUNK), str(tmp_path / "i"), slots=4, cells=2)
    own = index.Index(spark, str(tmp_path / "i"))
    parents = own.points.select("parent_id", "text", "page_start", "page_end").dropDuplicates(["parent_id"])
    rows = lambda df: sorted(map(str, df.collect()))
    for mode in ("neighbors", "auto"):
        passages = own.answer(asked, parents, mode)[1]
        # the search ran before, and its hits are read
        assert scanned(passages, "postings") == [] and scanned(passages, "vectors") == []
        with monkeypatch.context() as many:
            many.setattr(index, "SENT", 0)
            assert rows(passages) == rows(own.answer(asked, parents, mode)[1])


@pytest.mark.parametrize("name", [None, *sorted(analysis.LANGUAGES)])
def test_a_word_is_stemmed_once_where_it_is_packed(spark, name):
    """The plain stemmer gives what the columns give, sees a word once for all texts, and words of one stem are one term."""
    stem, calls = analysis.stemmer(name), []
    texts = [["walking", "walked", "boxes", "walking"], [], ["walking", "nationen", "zz"], VOCAB]
    own = spark.createDataFrame([(t,) for t in texts], "w array<string>")
    want = [r.t for r in own.select(analysis.stems(F.col("w"), name).alias("t")).collect()]
    assert [[stem(w) if stem else w for w in t] for t in texts] == want
    row, code, n, words = index._tallied(pa.array(texts, pa.list_(pa.string())), stem and (lambda w: (calls.append(w), stem(w))[1]))
    assert {(r, words[c]): k for r, c, k in zip(row, code, n)} == {(i, w): t.count(w) for i, t in enumerate(want) for w in t}
    assert len(calls) == len(set(calls)) and len(words) == len(set(words))


def test_stages_are_released_and_settings_stay(spark):
    before = spark.conf.get(sinks.TIDY, None)
    rows = sinks.stage(spark.range(9).withColumnRenamed("id", "k"), "k")
    (path, name), there = rows._staged, lambda p: os.path.exists(p.removeprefix("file://"))
    assert there(path) and spark.catalog.tableExists(name)
    sinks.release(rows)
    assert not there(path) and not spark.catalog.tableExists(name)
    with sinks.tidy(spark):
        assert spark.conf.get(sinks.TIDY) == "true"
    assert spark.conf.get(sinks.TIDY, None) == before


def test_removed_vectors_are_left_out_without_unpacking(spark, tmp_path, asked, monkeypatch):
    rows, path = corpus(spark, 30), str(tmp_path / "i")
    index.build(spark.createDataFrame(rows, CHUNK), path, slots=2, cells=2)
    index.update(spark.createDataFrame([], CHUNK), path, removed=spark.createDataFrame([(r[0],) for r in rows[::3]], "chunk_id string"))
    own, made, plain = index.Index(spark, path), [], vectors.unpack
    monkeypatch.setattr(vectors, "unpack", lambda *a: (made.append(a), plain(*a))[1])
    found = lambda: sorted(map(tuple, own.near(index.hashed_terms(asked, "query_id", "text"), 3).collect()))
    ahead = found()
    assert not made and {r[1] for r in ahead}.isdisjoint(r[0] for r in rows[::3])
    # where the first look may miss some, all are looked at
    monkeypatch.setattr(index, "AHEAD", 1)
    assert found() == ahead and made
