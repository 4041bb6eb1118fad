"""Queries of this package and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.spark import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import bpe

    return bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer_path())


def _labels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, sf_dir, "labels").selectExpr("doc_id", f"{name} AS label")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import licenses

    return licenses.scan(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import toxicity

    return toxicity.classify(read(spark, sf_dir, "documents"), _labels(spark, sf_dir, "toxic"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import quality

    return quality.classify(read(spark, sf_dir, "documents"), _labels(spark, sf_dir, "quality"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import decontaminate

    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import rules

    return rules.judge(read(spark, sf_dir, "documents"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import jaccard

    return jaccard.join(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import pii

    return pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import substrings

    return substrings.deduplicate(read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import warc

    return warc.archive(read(spark, sf_dir, "pages"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import pieces

    return pieces.round_trip(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import prefixes

    return prefixes.trie(read(spark, sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm import spelling

    return spelling.variants(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from lectern.llm import licenses, prefixes, rules, spelling, warc

    return {"op2_rules": rules.SQL, "op3_licenses": licenses.sql(), "op10_warc": warc.SQL, "op12_prefixes": prefixes.SQL, "op13_spelling": spelling.SQL}
