"""Substring deduplication with difference-cover anchors.

A word is removed if a window of ``WINDOW`` = 50 words that covers it also
starts in a document with a smaller id.  Windows are hashed in two steps.

Anchors are hashes of 20 words at the positions whose index modulo 31 is in a
difference cover: for any two positions there is an offset below 31 that takes
both into the cover, so two equal windows of 50 words always have an equal
anchor at the same offset in both.  An anchor found in one document only rules
out the windows around it; the rest extends to full windows, which are hashed
(96 bits, of two independent hashes of each word) and compared by document id.

Documents are dealt once into blocks of a few MB, in a bucketed table.  A block
sends each distinct hash once, with its least document id, and gets back which
hashes other blocks share or hold in an earlier document.  A passage that
occurs in a third of all documents is therefore one entry for each block, not
one for each document.  Documents equal to an earlier one as a whole are found
in the first step and take no part in the second.

Null and empty texts have no words.  Every input row gives one row; rows with
one ``doc_id`` never remove words of each other, and rows without ``doc_id``
keep all words and remove none.  Other columns are ignored.  A very long text
is part of one block as a whole, which then is larger than the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.jaccard import _flat
from lectern.llm.spark import groups_for, settle, settle_bucketed, shuffle_width
from lectern.llm.words import KEYS, hash_words, mix, release, split_words, windows

WINDOW = 50
#: A perfect difference set: every difference modulo 31 occurs once.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of input for each block of documents and each group of hashes.
BLOCK_BYTES = 4 << 20

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_SECOND = np.uint64(0xA0761D6478BD642F)
ROW = "kind int, b int, doc_id long, n_words long, n_removed long, kept_sha256 string, text string, at binary, w int, w1 binary, w2 binary, mins binary"
_ROW = pa.schema([("kind", pa.int32()), ("b", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("at", pa.binary()), ("w", pa.int32()), ("w1", pa.binary()), ("w2", pa.binary()), ("mins", pa.binary())])


class Texts:
    """Words of a block's documents, their hashes and positions."""

    def __init__(self, table: pa.Table):
        text = table.column("text").combine_chunks()
        self.flat, self.off = split_words(text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks))
        coded = self.flat.dictionary_encode()
        self.h, self.second = (hash_words(coded, key) for key in KEYS)
        self.n = np.diff(self.off)
        ids = table.column("doc_id")
        self.id = pc.fill_null(ids, 0).to_numpy()
        self.valid = ids.is_valid().to_numpy()
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.local = np.arange(len(self.h)) - self.off[self.doc]
        self.usable = (self.n >= WINDOW) & self.valid

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of all anchors."""
        ok = _IN_COVER[self.local % PERIOD] & self.usable[self.doc] & (self.local <= self.n[self.doc] - ANCHOR)
        at = np.flatnonzero(ok)
        return at, windows(self.h, ANCHOR)[at] if len(at) else self.h[:0]

    def whole(self) -> np.ndarray:
        """128-bit hash of each usable document's words, as two columns."""
        out = np.zeros((len(self.n), 2), np.uint64)
        at = self.local.astype(np.uint64)
        for k, (h, seed) in enumerate(((self.h, np.uint64(0x9E3779B97F4A7C15)), (self.second, _SECOND))):
            each = mix((h ^ seed) + mix(at * seed + seed))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
            out[:, k] = total[self.off[1:]] - total[self.off[:-1]]
        return out[self.usable]

    def full(self, at: np.ndarray) -> np.ndarray:
        """96-bit hashes of the windows that start at flat positions ``at``, as two columns."""
        if not len(at):
            return np.zeros((0, 2), np.uint64)
        second = windows(self.second, WINDOW)[at] >> np.uint64(32)
        return np.stack([windows(self.h, WINDOW)[at], second], axis=1)

    def digests(self, keep: np.ndarray | None = None) -> list[str]:
        """SHA-256 of each document's kept words joined by one space."""
        flat, off = self.flat, self.off
        if keep is not None:
            off = np.concatenate([[0], np.cumsum(keep)])[off]
            flat = flat.filter(pa.array(keep))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(off, pa.int32()), flat), " ")
        return [hashlib.sha256(t.as_buffer()).hexdigest() for t in joined]


def least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of ``keys``, the least id of each, and each row's index among them."""
    order = np.lexsort((ids, keys[:, 1], keys[:, 0]))
    k = keys[order]
    head = np.ones(len(k), bool)
    head[1:] = (k[1:] != k[:-1]).any(axis=1)
    index = np.empty(len(k), np.int64)
    index[order] = np.cumsum(head) - 1
    return k[head], ids[order][head], index


def held(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each row of ``keys`` is one of the rows ``among``."""
    if not len(among) or not len(keys):
        return np.zeros(len(keys), bool)
    a = np.ascontiguousarray(keys).view("u8,u8").ravel()
    b = np.ascontiguousarray(among).view("u8,u8").ravel()
    both = np.unique(np.concatenate([b, a]), return_inverse=True)[1]
    return np.isin(both[len(b) :], both[: len(b)])


def by(place: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Blobs of the columns for each value of ``place``."""
    order = np.argsort(place, kind="stable")
    place = place[order]
    columns = [c[order] for c in columns]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]]) if len(place) else np.zeros(1, np.int64)
    for a, b in zip(cut.tolist(), cut[1:].tolist()):
        yield int(place[a]), [c[a:b].tobytes() for c in columns]


def joined(table: pa.Table, name: str, dtype) -> np.ndarray:
    return _flat(table.column(name), dtype)[0]


FIRST = "a int, b int, anchors binary, h1 binary, h2 binary, docs binary"


def first_step(texts: DataFrame, width: int) -> DataFrame:
    """``b, anchors, h1, h2``: for each block, the anchors it shares with other blocks and the whole texts that have an earlier copy in one."""

    def send(key: tuple, table: pa.Table) -> pa.Table:
        release()
        t = Texts(table)
        _, anchor = t.anchors()
        anchor = np.unique(anchor)
        key_, low, _ = least(t.whole(), t.id[t.usable])
        rows = [(a, key[0].as_py(), x, b"", b"", b"") for a, (x,) in by((anchor % np.uint64(width)).astype(np.int32), anchor)]
        rows += [(a, key[0].as_py(), b"", *x) for a, x in by((key_[:, 0] % np.uint64(width)).astype(np.int32), key_[:, 0], key_[:, 1], low)]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], ["a", "b", "anchors", "h1", "h2", "docs"])

    def meet(table: pa.Table) -> pa.Table:
        block = table.column("b").to_numpy()
        anchor, n = _flat(table.column("anchors"), np.uint64)
        owner = np.repeat(block, n)
        order = np.argsort(anchor, kind="stable")
        anchor, owner = anchor[order], owner[order]
        same = anchor[1:] == anchor[:-1]
        many = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(anchor) else np.zeros(0, bool)
        rows = [(b, x, b"", b"") for b, (x,) in by(owner[many], anchor[many])]
        h1, n = _flat(table.column("h1"), np.uint64)
        keys, docs, owner = np.stack([h1, joined(table, "h2", np.uint64)], axis=1), joined(table, "docs", np.int64), np.repeat(block, n)
        _, low, index = least(keys, docs)
        later = docs > low[index] if len(docs) else np.zeros(0, bool)
        rows += [(b, b"", *x) for b, x in by(owner[later], keys[later, 0], keys[later, 1])]
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], ["b", "anchors", "h1", "h2"])

    sent = texts.groupBy("b").applyInArrow(send, FIRST)
    return sent.groupBy("a").applyInArrow(meet, "b int, anchors binary, h1 binary, h2 binary")


def second_step(texts: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """Rows of ``ROW``: kind 0 finished documents, 1 documents with windows to judge, 2 those windows' hashes by place."""

    def extend(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _ROW.empty_table()
        release()
        t, b = Texts(table), key[0].as_py()
        at, anchor = t.anchors()
        whole = t.whole()
        distinct, low, index = least(whole, t.id[t.usable])
        earlier = held(distinct, np.stack([joined(told, "h1", np.uint64), joined(told, "h2", np.uint64)], axis=1))
        copy = np.zeros(len(t.n), bool)
        if len(index):
            copy[t.usable] = (t.id[t.usable] > low[index]) | earlier[index]
        # shared with another block, or by two documents of this one
        pair = np.stack([anchor, t.id[t.doc[at]].view(np.uint64)], axis=1)
        pair = least(pair, np.zeros(len(pair), np.int64))[0][:, 0] if len(pair) else anchor
        shared = np.union1d(joined(told, "anchors", np.uint64), pair[1:][pair[1:] == pair[:-1]])
        at = at[np.isin(anchor, shared) & ~copy[t.doc[at]]]
        # the windows that contain such an anchor
        low_, high_ = np.maximum(at - (PERIOD - 1), t.off[t.doc[at]]), np.minimum(at, t.off[t.doc[at] + 1] - WINDOW)
        step = np.zeros(len(t.h) + 1, np.int64)
        fit = high_ >= low_
        np.add.at(step, low_[fit], 1)
        np.add.at(step, high_[fit] + 1, -1)
        start = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        open_ = np.zeros(len(t.n), bool)
        open_[t.doc[start]] = True
        sha = t.digests()
        nothing = hashlib.sha256(b"").hexdigest()
        done = np.flatnonzero(~open_)
        ids = table.column("doc_id")
        parts = [pa.table({"kind": pa.array(np.zeros(len(done)), pa.int32()), "b": pa.array(np.full(len(done), b), pa.int32()), "doc_id": ids.take(pa.array(done)), "n_words": pa.array(t.n[done]), "n_removed": pa.array(np.where(copy, t.n, 0)[done]), "kept_sha256": pa.array([nothing if copy[i] else sha[i] for i in done.tolist()], pa.string())})]
        todo = np.flatnonzero(open_)
        spots = dict(by(t.doc[start], t.local[start].astype(np.int32)))
        parts.append(pa.table({"kind": pa.array(np.ones(len(todo)), pa.int32()), "b": pa.array(np.full(len(todo), b), pa.int32()), "doc_id": ids.take(pa.array(todo)), "text": table.column("text").take(pa.array(todo)), "at": pa.array([spots[i][0] for i in todo.tolist()], pa.binary())}))
        keys, low, _ = least(t.full(start), t.id[t.doc[start]])
        rows = list(by((keys[:, 0] % np.uint64(width)).astype(np.int32), keys[:, 0], keys[:, 1].astype(np.uint32), low))
        parts.append(pa.table({"kind": pa.array(np.full(len(rows), 2), pa.int32()), "b": pa.array(np.full(len(rows), b), pa.int32()), "w": pa.array([w for w, _ in rows], pa.int32()), **{c: pa.array([x[k] for _, x in rows], pa.binary()) for k, c in enumerate(("w1", "w2", "mins"))}}))
        return pa.concat_tables([p.select([c for c in _ROW.names if c in p.column_names]).cast(pa.schema([_ROW.field(c) for c in _ROW.names if c in p.column_names])) for p in parts], promote_options="default").select(_ROW.names)

    return texts.groupBy("b").cogroup(known.groupBy("b")).applyInArrow(extend, ROW)


def earlier_windows(sent: DataFrame) -> DataFrame:
    """``b, w1, w2``: for each block, its windows that start in an earlier document of another block."""

    def meet(table: pa.Table) -> pa.Table:
        w1, n = _flat(table.column("w1"), np.uint64)
        keys, docs = np.stack([w1, joined(table, "w2", np.uint32).astype(np.uint64)], axis=1), joined(table, "mins", np.int64)
        owner = np.repeat(table.column("b").to_numpy(), n)
        _, low, index = least(keys, docs)
        later = docs > low[index]
        rows = [(b, *x) for b, x in by(owner[later], keys[later, 0], keys[later, 1].astype(np.uint32))]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 3, (pa.int32(), pa.binary(), pa.binary()))], ["b", "w1", "w2"])

    return sent.select("w", "b", "w1", "w2", "mins").groupBy("w").applyInArrow(meet, "b int, w1 binary, w2 binary")


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _judge(table: pa.Table, told: pa.Table) -> tuple[Texts, np.ndarray]:
    """The words of a block's open documents and which of them stay."""
    t = Texts(table)
    spot, n = _flat(table.column("at"), np.int32)
    doc = np.repeat(np.arange(len(n)), n)
    start = spot + t.off[doc]
    keys = t.full(start)
    distinct, low, index = least(keys, t.id[doc])
    early = held(distinct, np.stack([joined(told, "w1", np.uint64), joined(told, "w2", np.uint32).astype(np.uint64)], axis=1))
    gone = start[(t.id[doc] > low[index]) | early[index]]
    step = np.zeros(len(t.h) + 1, np.int64)
    np.add.at(step, gone, 1)
    np.add.at(step, gone + WINDOW, -1)
    return t, np.cumsum(step[:-1]) == 0


def last_step(open_: DataFrame, early: DataFrame) -> DataFrame:
    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})
        t, keep = _judge(table, told)
        removed = np.bincount(t.doc[~keep], minlength=len(t.n))
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(t.n), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(t.digests(keep), pa.string())})

    return open_.groupBy("b").cogroup(early.groupBy("b")).applyInArrow(finish, OUT)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    width, parts = shuffle_width(docs.sparkSession), groups_for(docs, BLOCK_BYTES)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")
    texts = settle_bucketed(docs.select("doc_id", "text", block.alias("b")), "b", width)
    # every block sends a row to every place where hashes meet, so there are fewer of those
    places = max(width, parts // 4)
    known = settle(first_step(texts, places))
    rows = settle(second_step(texts, known, places))
    early = earlier_windows(rows.filter("kind = 2"))
    rest = last_step(rows.filter("kind = 1").select("b", "doc_id", "text", "at"), early)
    return rows.filter("kind = 0").select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(rest)
