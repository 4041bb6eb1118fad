"""Prefix trie of conversations: range-sorted turn arrays, adjacent LCPs and a stack sweep.

Turns are digests (128 bits of role and text) with the size of their text.  The
arrays are sorted over the whole cluster, copies by their ids, so one group of
copies may fill many partitions.  In sorted order the conversations that start
with a given prefix are an interval; a task sweeps its rows with a stack that
holds the path of the last one, and the LCP with the next row says which nodes
end there.  Nodes with neither the first nor the last row of a partition are
complete.  Those on these two paths go on to the stitching sweep, which runs the
same stack over the paths of all partitions in order: its rows are two paths for
each partition, not conversations.

Rows without a ``conv_id`` belong to no conversation; a null role or text is
empty; null turns come first.  Rows of one conversation with equal turns are
ordered by role and text.  Repeated rows count as turns of their own.  Columns
besides the four are ignored.  An empty table gives no rows, not even a root.
A conversation is one row of 20 bytes a turn, whatever its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import sql
from lectern.llm.bpe import spread
from lectern.llm.spark import in_arrow, settle, shuffle_width

#: Conversations of one hundred share up to ``BORROWED - 1`` first turns of the one whose id they round down to.
FAMILY, BORROWED = 100, 6
#: Rows of an output batch.
ROWS = 20_000
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 binary"
#: ``kind``: DONE; WAITING for the parent that ``part, branch, at`` names; OPEN, the unfinished node of that name, with its turn and the ids
#: ending there; NAMED, the smallest member of a node by one of its names.
_DONE, _WAITING, _OPEN, _NAMED = range(4)
_SWEPT = f"kind int, {_NODE}, part int, branch int, at long, a long, b long, size long, ends binary"
_STITCHED = f"kind int, {_NODE}, part int, branch int, at long"


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the digests and text sizes of each conversation's turns in order."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    # a constant in front makes the second hash independent of the first
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("place"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit("turn"), "text", "role"), "size": F.length("text")})
    plain = settle(rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "a", "b", "size"))).alias("t")))
    ties = plain.filter("exists(zip_with(slice(t, 1, size(t) - 1), slice(t, 2, size(t) - 1), (x, y) -> x.place <=> y.place AND (x.a <> y.a OR x.b <> y.b)), x -> x)").select("conv_id")
    turns = "transform(t, x -> struct(x.a AS a, x.b AS b, x.size AS size)) AS turns"
    if ties.isEmpty():
        return plain.selectExpr("conv_id", turns)
    again = rows.join(ties, "conv_id", "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text", "a", "b", "size"))).alias("t"))
    return plain.join(ties, "conv_id", "left_anti").selectExpr("conv_id", turns).union(again.selectExpr("conv_id", turns))


def borrowed(arrays: DataFrame) -> DataFrame:
    """Each conversation with its first turns replaced by those of its family's first conversation.

    The first ``h`` of ``conv_id - conv_id % FAMILY`` (all it has, if fewer) and
    then the own ones after the first ``h``, with ``h`` the crc32 of the decimal
    id modulo ``BORROWED``.
    """
    h = F.expr(f"cast(crc32(cast(conv_id AS string)) % {BORROWED} AS int)")
    first = arrays.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("of"), F.slice("turns", 1, BORROWED - 1).alias("lead"))
    own = arrays.withColumns({"h": h, "of": F.col("conv_id") - F.col("conv_id") % FAMILY})
    lead = F.expr("slice(coalesce(lead, slice(turns, 1, 0)), 1, h)")
    rest = F.expr("slice(turns, h + 1, size(turns))")
    return own.join(first, "of", "left").select("conv_id", F.concat(lead, rest).alias("turns"))


class Node:
    """An open node: what its finished children and the conversations that end there have brought so far."""

    __slots__ = ("a", "b", "size", "edge", "least", "n", "children", "leaves", "saved", "ends", "ended", "kids", "names")

    def __init__(self, a: int, b: int, size: int, edge: bool = False):
        self.a, self.b, self.size, self.edge = a, b, size, edge
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.ended, self.kids, self.names = [], False, [], []

    def member(self, least: int, n: int) -> None:
        self.least = least if self.least is None else min(self.least, least)
        self.n += n

    def finish(self, depth: int, parent: Node | None, digest: bytes) -> tuple:
        """The node's row, but for the parent's id; its sums go to the parent."""
        self.leaves += not self.children
        self.saved += (self.n - 1) * self.size
        if parent is not None:
            parent.member(self.least, self.n)
            parent.children += 1
            parent.leaves += self.leaves
            parent.saved += self.saved
        return self.least, depth, None, self.n, self.children, self.leaves, self.saved, digest


class Out:
    """Rows of a sweep, in batches."""

    def __init__(self, ddl: str):
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        self.schema, self.rows = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))]), []

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
            self.rows = []


def _decimal(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one partition of sorted arrays."""
    part, out = TaskContext.get().partitionId(), Out(_SWEPT)
    stack: list[Node] = []
    edge = None  # down to this depth the path is that of the partition's first row
    before = np.zeros((3, 0), np.int64)

    def open_row(node: Node, depth: int, branch: int) -> tuple:
        sums = (node.least, depth, None, node.n, node.children, node.leaves, node.saved, None)
        return _OPEN, *sums, part, branch, depth, node.a, node.b, node.size, _decimal(node.ends) if node.ends else None

    def close(down_to: int) -> None:
        while len(stack) > down_to + 1:
            node, depth = stack.pop(), len(stack)
            if node.edge:
                out.rows.append(open_row(node, depth, 0))
                continue
            row = node.finish(depth, stack[-1], hashlib.sha256(_decimal(node.ends)).digest())
            out.rows += [(_DONE, *kid[:2], node.least, *kid[3:], *[None] * 7) for kid in node.kids]
            if stack[-1].edge:
                out.rows.append((_WAITING, *row, part, 0, depth - 1, *[None] * 4))
            else:
                stack[-1].kids.append(row)

    for batch in batches:
        if not batch.num_rows:
            continue
        lists, ids = batch.column("turns"), batch.column("conv_id").to_pylist()
        flat, off = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        # the row before this batch goes in front, so that each row has one before it
        off = np.concatenate([[0], off - off[0] + before.shape[1]])
        turns = np.concatenate([before, np.stack([flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])], axis=1)
        size = np.diff(off)
        both = np.minimum(size[1:], size[:-1])
        same = (turns[:2, spread(off[1:-1], both)] == turns[:2, spread(off[:-2], both)]).all(axis=0)
        at = off.tolist()
        for k, (conv, shared) in enumerate(zip(ids, _leading(same, both).tolist()), 1):
            if edge is None:
                stack.append(Node(0, 0, 0, True))
                edge = at[k + 1] - at[k]
            else:
                close(shared)
                edge = min(edge, shared)
            for a, b, length in turns[:, at[k] + len(stack) - 1 : at[k + 1]].T.tolist():
                stack.append(Node(a, b, length, len(stack) <= edge))
            stack[-1].member(conv, 1)
            stack[-1].ends.append(conv)
            yield from out.batches(ROWS)
        before = turns[:, at[-2] : at[-1]].copy()
    common = sum(node.edge for node in stack)
    for depth, node in enumerate(stack):
        branch = int(depth >= common)
        out.rows.append(open_row(node, depth, branch))
        out.rows += [(_WAITING, *kid, part, branch, depth, *[None] * 4) for kid in node.kids]
    yield from out.batches(1)


def _leading(same: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How many values at the start of each group of ``count`` are true."""
    ends = np.cumsum(count)
    wrong = np.concatenate([np.flatnonzero(~same), [len(same)]])
    return np.minimum(wrong[np.searchsorted(wrong, ends - count)], ends) - (ends - count)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes on the edges of partitions, and the smallest member of each by its names; rows come by partition, branch and depth."""
    out = Out(_STITCHED)
    stack: list[Node] = []
    follows = False  # the rows so far of this partition are the path in the stack

    def close(down_to: int) -> None:
        while len(stack) > down_to + 1:
            node, depth = stack.pop(), len(stack)
            row = node.finish(depth, stack[-1] if stack else None, node.ends.digest())
            out.rows += [(_DONE, *kid[:2], node.least, *kid[3:], *[None] * 3) for kid in node.kids]
            out.rows += [(_NAMED, node.least, *[None] * 7, *name) for name in node.names]
            if stack:
                stack[-1].kids.append(row)
            else:
                out.rows.append((_DONE, *row, *[None] * 3))

    for batch in batches:
        for r in batch.to_pylist():
            at = r["at"]
            follows = (follows or at == 0) and not r["branch"] and at < len(stack) and (stack[at].a, stack[at].b) == (r["a"], r["b"])
            if not follows:
                close(at - 1)
                stack.append(Node(r["a"], r["b"], r["size"]))
                stack[at].ends = hashlib.sha256()
            node = stack[at]
            if r["n_convs"]:
                node.member(r["conv_id"], r["n_convs"])
            node.children += r["n_children"]
            node.leaves += r["n_leaves"]
            node.saved += r["saved_tokens"]
            if r["ends"] is not None:
                node.ends.update(b"," * node.ended + r["ends"])
                node.ended = True
            node.names.append((r["part"], r["branch"], at))
            yield from out.batches(ROWS)
    close(-1)
    yield from out.batches(1)


def nodes(arrays: DataFrame) -> DataFrame:
    """The trie of ``conv_id, turns``: a row for each node, as ``trie`` describes it."""
    spark = arrays.sparkSession
    dealt = settle(arrays).repartitionByRange(shuffle_width(spark), "turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    swept = settle(in_arrow(dealt, _sweep, _SWEPT))
    paths = swept.filter(F.col("kind") == _OPEN).repartition(1).sortWithinPartitions("part", "branch", "at")
    stitched = settle(in_arrow(paths, _stitch, _STITCHED), light=True)
    name = ["part", "branch", "at"]
    parents = stitched.filter(F.col("kind") == _NAMED).select(*name, F.col("conv_id").alias("parent"))
    waiting = swept.filter(F.col("kind") == _WAITING).join(parents, name).withColumn("parent_conv_id", F.col("parent"))
    columns = [c.split()[0] for c in _NODE.split(", ")]
    done = [rows.filter(F.col("kind") == _DONE).select(columns) for rows in (swept, stitched)]
    return done[0].union(done[1]).union(waiting.select(columns)).withColumn("ends_sha256", F.lower(F.hex("ends_sha256")))


def trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations.

    Each distinct sequence of first turns is a node, the root at depth 0 without
    a turn.  ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (the
    parent's ``conv_id``), ``n_convs`` (members), ``n_children``, ``n_leaves``
    (nodes without children in its subtree, itself included), ``saved_tokens``
    (over its subtree, the code points of each node's last text times its
    members but one), ``ends_sha256`` (of the ids of the members that end there,
    joined by commas).
    """
    return nodes(borrowed(turn_arrays(conversations)))


_DIGITS = "list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)"
#: DuckDB SQL for ``trie`` of the table ``conversations``.
SQL = f"""{sql.CRC_TABLE},
own AS (
  SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cut AS (SELECT conv_id, t, {sql.crc32(_DIGITS)} % {BORROWED} h FROM (SELECT *, conv_id::VARCHAR s FROM own), crc),
rebuilt AS (
  SELECT c.conv_id, list_concat(CASE WHEN b.t IS NULL THEN [] ELSE b.t[1:c.h] END, c.t[c.h + 1:]) t
  FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % {FAMILY}),
steps AS (SELECT conv_id, t, d, CASE WHEN d = 0 THEN '' ELSE sha256(t[1:d]::VARCHAR) END p, CASE WHEN d < 2 THEN '' ELSE sha256(t[1:d - 1]::VARCHAR) END up FROM rebuilt, unnest(range(length(t) + 1)) u(d)),
nodes AS (
  SELECT d, p, any_value(up) up, min(conv_id) conv_id, count(*) n, CASE WHEN d = 0 THEN 0 ELSE any_value(length(t[d][2])) END size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length(t) = d), '')) ends_sha256
  FROM steps GROUP BY d, p),
kids AS (SELECT d - 1 d, up p, count(*) n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
sums AS (
  SELECT x.d, x.p, sum((k.n_children IS NULL)::BIGINT)::BIGINT n_leaves, sum((y.n - 1) * y.size)::BIGINT saved_tokens
  FROM (SELECT DISTINCT a.d, a.p, b.d yd, b.p yp FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND b.d >= a.d) x
  JOIN nodes y ON y.d = x.yd AND y.p = x.yp LEFT JOIN kids k ON k.d = y.d AND k.p = y.p GROUP BY 1, 2)
SELECT n.conv_id, n.d::BIGINT depth, u.conv_id parent_conv_id, n.n n_convs, coalesce(k.n_children, 0) n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.p = n.p LEFT JOIN kids k ON k.d = n.d AND k.p = n.p LEFT JOIN nodes u ON n.d > 0 AND u.d = n.d - 1 AND u.p = n.up"""
