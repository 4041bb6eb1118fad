import pytest

from lectern.plans import registry
from lectern.sources import readers, sinks

MANIFEST = """documents:
  - id: one-book
    path: a.pdf
    title: "A: title"
    publication_year: 2020
    document_type: book
    domain: web
    chunk_profile: default
    chunking:
      maximum_tokens: 300
  - id: two
    path: b.pdf
    title: B
    publication_year: 2021
    document_type: book
    domain: web
    chunk_profile: case_study
"""


def test_manifest(spark, tmp_path):
    f = tmp_path / "m.yaml"
    f.write_text(MANIFEST)
    got = readers.manifest(spark, str(f))
    assert [e["id"] for e in got] == ["one-book", "two"] and got[0]["chunking"] == {"maximum_tokens": 300} and got[0]["title"] == "A: title"
    for bad in (MANIFEST.replace("two", "one-book"), MANIFEST.replace("two", "Two"), MANIFEST.replace("    domain: web\n", "", 1), "documents:\n"):
        f.write_text(bad)
        with pytest.raises(readers.ManifestError):
            readers.manifest(spark, str(f))


def test_json_lines(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(f), "a int").collect()) == [1, 2]
    f.write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception):
        readers.json_lines(spark, str(f), "a int").collect()
    assert [r.line for r in readers.bad_lines(spark, str(f), "a int").collect()] == [2]


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, v int")
    assert sinks.upsert(a, path).count() == 2
    sinks.upsert(spark.createDataFrame([("y", 3), ("z", 4)], "id string, v int"), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("x", 1), ("y", 2), ("z", 4)]


def test_stream(spark, tmp_path):
    from lectern.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"chunk_id": "1", "text": "Same  text"}\n{"chunk_id": "2", "text": "same text"}\n')
    for _ in range(2):
        ingest.index(ingest.new_chunks(spark, str(tmp_path / "in"), "chunk_id string, text string"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [r.chunk_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["1"]


def test_every_sql_has_a_query():
    assert set(registry.sql.queries()) <= set(registry.queries())


@pytest.mark.parametrize("name", ["token_count", "overlap_chunks", "level_stack_parent", "bm25_topk", "margin_signatures"])
def test_query_equals_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = registry.queries()[name](spark, d)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(cols).collect()))) == sorted(map(repr, want))
