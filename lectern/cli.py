"""Command line: ``python -m lectern sections|chunks|files|index|search``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.analysis import LANGUAGES
from lectern.operators import index, retrieval, validate
from lectern.plans import process
from lectern.sources import ledger, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lectern", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *paths: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name, help=text)
        for p in paths:
            own.add_argument(f"--{p}", required=True)
        own.add_argument("--document", action="append", help="only this document; may be given again")
        return own

    own = command("sections", "find headings and cut documents into sections", "manifest", "extracted", "processed")
    own.add_argument("--minimum-section-characters", type=int, default=80)
    own = command("chunks", "make parents and overlapping chunks", "manifest", "processed")
    own.add_argument("--maximum-tokens", type=int)
    own.add_argument("--overlap-tokens", type=int)
    own = command("index", "index the chunks", "processed", "index")
    own.add_argument("--recreate", action="store_true", help="replace an index that exists")
    own.add_argument("--update", action="store_true", help="bring an index that exists up to date; only what changed is indexed")
    own.add_argument("--compact", action="store_true", help="fold an index's segments into one and remove older ones afterwards")
    own.add_argument("--bm25-language", choices=sorted(LANGUAGES), default="english", help="of stop words and stems, kept in the index")
    own = commands.add_parser("files", help="tell which source files changed since the last time, and record them")
    own.add_argument("--sources", required=True)
    own.add_argument("--ledger", required=True)
    own = command("search", "search the index", "processed", "index")
    own.add_argument("--query", action="append", required=True, help="may be given again")
    own.add_argument("--top-k", type=int, default=retrieval.TOP_K)
    own.add_argument("--candidate-limit", type=int, default=retrieval.CANDIDATES)
    own.add_argument("--maximum-per-parent", type=int, default=retrieval.PER_PARENT)
    own.add_argument("--context-mode", choices=retrieval.MODES, default="auto")
    own.add_argument("--neighbor-window", type=int, default=retrieval.WINDOW)
    own.add_argument("--parent-token-limit", type=int, default=retrieval.PARENT_LIMIT)
    own.add_argument("--context-token-budget", type=int, default=retrieval.CONTEXT_BUDGET)
    own.add_argument("--probes", type=int, help="vector cells to look at; all by default, which is exact")
    own.add_argument("--json", action="store_true", help="print one JSON object for each query, with hits and contexts")
    own.add_argument("--output", help="also write hits and contexts here, as JSON lines")
    return top


def _corpus(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    parents, chunks = (spark.read.parquet(f"{args.processed}/{t}") for t in ("parents", "chunks"))
    if args.document:
        known = chunks.select("document_id").distinct()
        unknown = validate.unknown_ids(spark.createDataFrame([(x,) for x in args.document], "document_id string"), known).first()
        if unknown is not None:
            raise ValueError(f"no such document: {unknown.document_id}")
        parents, chunks = (df.filter(F.col("document_id").isin(args.document)) for df in (parents, chunks))
    return parents, chunks


def run(spark: SparkSession, argv: Sequence[str]) -> list[str]:
    """Run one command; the lines it prints come back."""
    args = parser().parse_args(argv)
    if args.command == "sections":
        report = process.detect_sections(spark, args.manifest, args.extracted, args.processed, args.document, args.minimum_section_characters)
        return [f"[OK] {r.document_id}: {r.section_count} sections, {r.indexable_section_count} indexable, mode={r.detection_mode}" for r in report.orderBy("document_id").collect()]
    if args.command == "chunks":
        report = process.make_chunks(spark, args.manifest, args.processed, args.document, args.maximum_tokens, args.overlap_tokens)
        return [f"[OK] {r.document_id}: {r.parent_count} parents, {r.chunk_count} chunks, {r.duplicate_chunk_count} duplicates" for r in report.orderBy("document_id").collect()]
    if args.command == "files":
        found = sinks.stage(ledger.changes(spark, args.sources, args.ledger))
        ledger.record(found, args.ledger)
        return [f"[{r.change}] {r.path}" for r in found.orderBy("path").collect()]
    parents, chunks = _corpus(spark, args)
    if args.command == "index":
        validate.validate(parents, chunks)
        if args.update:
            there = index.Index(spark, args.index).points.select("chunk_id")
            index.update(chunks, args.index, removed=there.join(chunks.select("chunk_id"), "chunk_id", "left_anti"))
        else:
            index.build(chunks, args.index, recreate=args.recreate, language=args.bm25_language, facts={"parent_count": parents.count(), "processed_root": args.processed})
        if args.compact:
            index.compact(args.index, spark)
            index.vacuum(args.index, spark)
        told = index.described(spark, args.index)
        return [f"Chunks: {told['chunk_count']}, parents: {told['parent_count']}, documents: {told['document_count']}"]
    found = index.Index(spark, args.index)
    queries = spark.createDataFrame(list(enumerate(args.query)), "query_id long, text string")
    only = F.col("document_id").isin(args.document) if args.document else None
    hits, passages = found.answer(
        queries, parents, args.context_mode, args.neighbor_window, args.parent_token_limit, args.context_token_budget,
        document=only, candidates=args.candidate_limit, top=args.top_k, per_parent=args.maximum_per_parent, probes=args.probes,
    )
    if args.output or args.json:
        hits, passages = sinks.stage(hits), sinks.stage(passages)
    if args.output:
        sinks.json_lines(hits, f"{args.output}/hits")
        sinks.json_lines(passages, f"{args.output}/contexts")
    if args.json:
        return [r.answer for r in sinks.answers(queries, hits, passages, _retrieval(args, found)).orderBy("query_id").collect()]
    lines = sinks.printable(hits, T.preview(F.col("text"))).withColumn("kind", F.lit(0)).unionByName(sinks.passages(passages).withColumn("kind", F.lit(1)))
    return [r.line for r in lines.orderBy("query_id", "kind", "position").collect()]


def _retrieval(args: argparse.Namespace, found: index.Index) -> dict:
    """How an answer was found."""
    told = index.described(found.spark, found.path)
    kept = ("collection_name", "dense_model", "sparse_model", "bm25_language", "fusion")
    return {k: told[k] for k in kept} | {"candidate_limit": args.candidate_limit, "top_k": args.top_k, "maximum_per_parent": args.maximum_per_parent, "context_mode": args.context_mode}


def main(argv: Sequence[str] | None = None) -> None:
    import sys

    spark = SparkSession.builder.appName("lectern").getOrCreate()
    for line in run(spark, sys.argv[1:] if argv is None else argv):
        print(line)
