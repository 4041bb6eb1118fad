"""Readers of the engine's files: JSON, JSON lines, manifests, binary files, corpora."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

REQUIRED = ("id", "path", "title", "publication_year", "document_type", "domain", "chunk_profile")
ID = re.compile(r"[a-z0-9][a-z0-9-]*")


class ManifestError(ValueError):
    """A manifest breaks a rule."""


def json_object(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object per file; anything else fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object per line; blank lines are skipped and a bad line fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``file, line``: lines that are no JSON object of the schema.

    Files are read in splits; a line's number is its place in its split after
    all lines of the file's earlier splits.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), "value")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = text.groupBy("file", "block").agg(F.min("m").alias("first"), F.count("value").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parsed = text.withColumn("row", F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    bad = parsed.filter((F.trim("value") != "") & (F.col("row").isNull() | F.col("row._corrupt").isNotNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))))
    return bad.join(splits, ["file", "block"]).select("file", (F.col("m") - F.col("first") + F.col("before") + 1).alias("line"))


def _scalar(text: str) -> Any:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        inner = text[1:-1]
        return inner.replace("''", "'") if text[0] == "'" else json.loads(text)
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in _outside(text[1:-1], ",") if x.strip()]
    if text in ("", "null", "~"):
        return None
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _outside(text: str, mark: str) -> list[str]:
    """``text`` cut at every ``mark`` outside quotes."""
    parts, quote = [""], ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"" and not parts[-1].strip():
            quote = c
        elif c == mark:
            parts.append("")
            continue
        parts[-1] += c
    return parts


def _uncommented(line: str) -> str:
    """The line up to a comment: a hash at its start or behind white space, outside quotes."""
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"" and line[:k].rstrip()[-1:] in ("", ":", "-", "[", ","):
            quote = c
        elif c == "#" and (k == 0 or line[k - 1].isspace()):
            return line[:k].rstrip()
    return line.rstrip()


_KEY = re.compile(r"""([^\s:'"][^:]*?|'[^']*'|"[^"]*")\s*:(?:\s+(.*))?""", re.S)


def _block(lines: list[tuple[int, str]], at: int, depth: int) -> tuple[Any, int]:
    """The mapping or list whose lines begin at ``depth``, and the index behind it."""
    if lines[at][1].startswith("-"):
        items: list[Any] = []
        while at < len(lines) and lines[at][0] == depth and re.match(r"-(\s|$)", lines[at][1]):
            body = lines[at][1][1:].lstrip()
            inner = depth + len(lines[at][1]) - len(body)
            if _KEY.fullmatch(body) or re.match(r"-(\s|$)", body):
                lines[at] = (inner, body)
                value, at = _block(lines, at, inner)
            elif body:
                value, at = _scalar(body), at + 1
            else:
                at += 1
                value, at = _block(lines, at, lines[at][0]) if at < len(lines) and lines[at][0] > depth else (None, at)
            items.append(value)
        return items, at
    found: dict[str, Any] = {}
    while at < len(lines) and lines[at][0] == depth and not re.match(r"-(\s|$)", lines[at][1]):
        m = _KEY.fullmatch(lines[at][1])
        if not m:
            raise ManifestError(f"cannot read manifest line: {lines[at][1]}")
        key, value = str(_scalar(m[1])), m[2]
        at += 1
        if value:
            found[key] = _scalar(value)
        elif at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and re.match(r"-(\s|$)", lines[at][1])):
            found[key], at = _block(lines, at, lines[at][0])
        else:
            found[key] = None
    return found, at


def manifest_entries(text: str) -> list[dict[str, Any]]:
    """Entries of a manifest: JSON, or block style with nested mappings, lists, quotes and comments; all under ``documents``."""
    if text.lstrip().startswith("{"):
        data = json.loads(text)
    else:
        lines = [(len(x) - len(x.lstrip()), x.strip()) for x in map(_uncommented, text.splitlines()) if x.strip() and x.strip() != "---"]
        if not lines:
            return []
        data, at = _block(lines, 0, lines[0][0])
        if at < len(lines):
            raise ManifestError(f"cannot read manifest line: {lines[at][1]}")
    entries = data.get("documents") if isinstance(data, dict) else None
    if entries is None:
        return []
    if not isinstance(entries, list) or not all(isinstance(e, dict) for e in entries):
        raise ManifestError("documents is no list of mappings")
    return entries


def manifest(spark: SparkSession, path: str, strict: bool = True) -> list[dict[str, Any]]:
    """Checked manifest entries: not empty, and if strict with all required fields, well-formed and unique ids."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    entries = manifest_entries(text)
    if not entries:
        raise ManifestError("the manifest lists no documents")
    if strict:
        seen: set[str] = set()
        for e in entries:
            absent = [k for k in REQUIRED if e.get(k) in (None, "")]
            if absent:
                raise ManifestError(f"{e.get('id')}: missing {', '.join(absent)}")
            if not ID.fullmatch(str(e["id"])):
                raise ManifestError(f"{e['id']}: ids have lower-case letters, digits and hyphens")
            if e["id"] in seen:
                raise ManifestError(f"{e['id']}: listed twice")
            seen.add(e["id"])
    return entries


def file_digests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, length, sha256`` of files, or of all below a folder, read as binary."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def corpus(spark: SparkSession, path: str, schema: StructType | str, documents: list[str] | None = None, required: bool = True) -> DataFrame:
    """A table partitioned by ``document_id``; only the chosen documents' folders are read.

    A missing table is an error, or has no rows if it is not ``required``.
    """
    if not exists(spark, path):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    return rows.filter(F.col("document_id").isin(documents)) if documents else rows
