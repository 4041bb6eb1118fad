"""The pipeline against plain Python, and its stages on the smallest tables against what each operator says of its own input."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from test_corpus_operators import brute_components, semi_global

import corpus_pipeline as P
from lectern.llm import decontaminate, jaccard, pii, quality, registry
from lectern.llm.spark import settle

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in P.STAGES:
        before = docs
        docs = settle(stage(spark, docs, D))
        seen.append((name, before, docs))
        if name != "bpe":
            assert docs.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    (_, a, b), (_, c, d), (_, e, f), (_, g, h), (_, i, j) = seen
    labels = spark.read.parquet(f"{D}/labels.parquet").selectExpr("doc_id", "quality AS label")
    assert ids(b) == ids(quality.classify(a, labels).filter("predicted = 1"))
    assert ids(d) == ids(jaccard.join(c).filter("doc_id = component_id"))
    assert ids(f) == ids(e) - ids(decontaminate.leaks(e, spark.read.parquet(f"{D}/benchmark.parquet")))
    assert {r.text for r in h.collect()} == {r.text for r in pii.pseudonymise(g).collect()}
    assert ids(j) == ids(i) and j.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_run_equals_plain_python(spark, tmp_path):
    """Rows of the whole pipeline against brute force for each stage and the tokenizers library."""
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(registry.tokenizer_path())
    rng = random.Random(3)
    vocab = [a + b for a in ("ta", "lo", "mi", "sen", "par", "ku") for b in ("rel", "vin", "dos", "gam", "ple")]
    prose = lambda n: ". ".join(" ".join(rng.choice(vocab) for _ in range(9)).capitalize() for _ in range(n // 9)) + "."
    item, texts = prose(36), []
    for k in range(120):
        kind = k % 6
        text = prose(90 + 9 * (k % 7)) if kind else " ".join(rng.choice(("###", "| | |", "BUY", "$$$", "!!!")) for _ in range(60))
        if kind == 2 and texts:
            text = texts[-1] + " " + rng.choice(vocab)
        if kind == 3:
            text += " " + item
        if kind == 4:
            text += f" Call +1 (551) 555-{k:04d} or write to n{k}@mail.example.com now."
        texts.append(text)
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 6 != 0), 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [(k, t) for k, t in enumerate(texts) if k % 6]  # classes are far apart
    groups = brute_components(kept)
    kept = [(k, t) for k, t in kept if groups[k][1] == k]
    norm = lambda t: re.sub(r"[^\w\s]", "", t.lower()).split()
    kept = [(k, t) for k, t in kept if semi_global(norm(item), norm(t)) > int(decontaminate.RATE * 36)]
    got = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}
    assert set(got) == {k for k, _ in kept} and {k % 6 for k in got} == {1, 4, 5}
    key = pii.session_key(spark)
    for k, t in kept:
        hidden = spark.createDataFrame([(t,)], "text string").select(pii.replace(F.col("text"), key)).first()[0] if k % 6 == 4 else t
        assert (f"n{k}@" not in hidden and f"555-{k:04d}" not in hidden) if k % 6 == 4 else hidden == t
        ids = lib.encode(hidden, add_special_tokens=False).ids
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256(hidden.encode()).hexdigest()


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for rows in (docs.limit(0), docs.limit(30).union(docs.limit(30)).union(spark.createDataFrame([(None, None, None, None, None)] * 2, docs.schema))):
        out = rows
        for _, stage in P.STAGES:
            out = settle(stage(spark, out, D))
        assert out.count() <= rows.count()
