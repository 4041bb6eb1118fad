"""Benchmark decontamination by pigeonhole edit matching.

Symbols are words, lower-cased and stripped of everything but letters and
digits.  An item of ``m`` words may be changed by ``k = floor(rate * m)`` word
edits; it is split into ``k + 1`` pieces, one of which must occur unchanged in
any text within that distance.  Piece hits are found through the hash of each
piece's first words, then Myers' bit-parallel algorithm gives the least edit
distance of the item to any run of words around the hit.

The benchmark is a stated query set: it is applied in blocks of at most
``BLOCK_WORDS`` words, ``SCAN_BLOCKS`` of them in one scan of the documents,
so what is sent at once has a fixed bound whatever the size of the benchmark.
Tasks hash and pack the items; the driver only hands packed blocks on.

Of places with the least distance the first is reported.  A very long text is
searched as a whole; its cost grows with its length, repeated passages included.
Null and empty texts and items without words match nothing.  Repeated
documents give repeated rows and repeated items their own rows; null ids are
kept as they are.  Items too short for one edit at the rate must occur
unchanged.  Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.spark import in_arrow, settle
from lectern.llm.words import hash_words, slices, split_words, windows

RATE = 0.15
#: Items whose pieces have fewer words are searched in blocks of their own, since a block looks for its shortest piece.
SHORT_PIECE = 4
#: Words of a block, and blocks that one scan of the documents looks for.
BLOCK_WORDS, SCAN_BLOCKS = 200_000, 16
SCHEMA = "doc_id long, item_id long, distance int, first_word long, last_word long"


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' normalised words and the offsets of each text."""
    flat, off = split_words(pc.fill_null(texts, ""))
    if len(flat) == 0:
        return np.zeros(0, np.uint64), off
    coded = flat.dictionary_encode()
    bare = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\p{L}\p{N}]+", "")
    known, empty = hash_words(bare), pc.equal(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
    at = coded.indices.to_numpy()
    keep = ~empty[at]
    return known[at[keep]], np.concatenate([[0], np.cumsum(keep)])[off]


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """``k + 1`` consecutive pieces of ``m`` words, equal but for one word."""
    cut = [i * m // (k + 1) for i in range(k + 2)]
    return list(zip(cut, cut[1:]))


def myers(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``item`` to a run of ``text``, and the run's end (exclusive).

    Bit ``i`` of the state words stands for row ``i`` of the distance column;
    Python integers hold items of any length.
    """
    m = len(item)
    peq: dict[int, int] = {}
    for i, s in enumerate(item.tolist()):
        peq[s] = peq.get(s, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, s in enumerate(text.tolist(), 1):
        eq = peq.get(s, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Block:
    """Piece index of some items."""

    def __init__(self, ids: list, items: list[np.ndarray], rate: float):
        self.ids, self.items = ids, items
        self.k = [int(rate * len(x)) for x in items]
        cuts = [pieces(len(x), k) for x, k in zip(items, self.k)]
        self.q = min((b - a for c in cuts for a, b in c), default=1)
        keys, item, at, size = [], [], [], []
        for n, (x, c) in enumerate(zip(items, cuts)):
            lead = windows(x, self.q)
            for a, b in c:
                keys.append(lead[a])
                item.append(n)
                at.append(a)
                size.append(b - a)
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.key = np.array(keys, np.uint64)[order]
        self.item, self.at, self.size = (np.array(v, np.int64)[order] for v in (item, at, size))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def search(self, h: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``text, item, distance, first word, last word`` of the best match of each item in each text."""
        lead = windows(h, self.q)
        spots = np.flatnonzero(self.seen[(lead & np.uint64((1 << 20) - 1)).astype(np.int64)])
        low = np.searchsorted(self.key, lead[spots], "left")
        high = np.searchsorted(self.key, lead[spots], "right")
        some = high > low
        spots, low, high = spots[some], low[some], high[some]
        text = np.searchsorted(off, spots, "right") - 1
        todo: dict[tuple[int, int], set[int]] = {}
        for p, t, a, b in zip(spots.tolist(), text.tolist(), low.tolist(), high.tolist()):
            for e in range(a, b):
                n, s, w = int(self.item[e]), int(self.at[e]), int(self.size[e])
                if p + w <= off[t + 1] and np.array_equal(h[p : p + w], self.items[n][s : s + w]):
                    todo.setdefault((t, n), set()).add(p - s)
        found = []
        for (t, n), starts in todo.items():
            item, k, best = self.items[n], self.k[n], None
            if k == 0:
                first = min(starts) - int(off[t])
                found.append((t, n, 0, first, first + len(item) - 1))
                continue
            m, at = len(item), np.sort(np.fromiter(starts, np.int64))
            # hits whose windows touch are looked at together
            cut = np.flatnonzero(np.diff(at) > m)
            for s, last in zip(at[np.concatenate([[0], cut + 1])].tolist(), at[np.concatenate([cut, [len(at) - 1]])].tolist()):
                a, b = max(int(off[t]), s - k), min(int(off[t + 1]), last + m + k)
                d, end = myers(item, h[a:b])
                if d <= k and (best is None or d < best[0]):
                    _, length = myers(item[::-1], h[a : a + end][::-1])
                    best = (d, a + end - length - int(off[t]), a + end - 1 - int(off[t]))
            if best:
                found.append((t, n, *best))
        return found


def _packed(batches: Iterator[pa.RecordBatch], rate: float) -> Iterator[pa.RecordBatch]:
    """Items with words, those of short pieces apart, in rows of about ``BLOCK_WORDS`` word hashes."""
    open_: dict[bool, list] = {False: [], True: []}
    size = {False: 0, True: 0}

    def row(short: bool) -> pa.RecordBatch:
        ids, items = zip(*open_[short])
        open_[short], size[short] = [], 0
        return pa.RecordBatch.from_arrays([pa.array([short]), pa.array([list(ids)], pa.list_(pa.int64())), pa.array([[len(x) for x in items]], pa.list_(pa.int64())), pa.array([np.concatenate(items).tobytes()])], ["short", "ids", "sizes", "words"])

    for batch in batches:
        for part in slices(batch, "text"):
            (h, off), ids = symbols(part.column("text")), part.column("item_id").to_pylist()
            for i, a, b in zip(ids, off.tolist(), off[1:].tolist()):
                if b > a:
                    short = (b - a) // (int(rate * (b - a)) + 1) < SHORT_PIECE
                    open_[short].append((i, h[a:b]))
                    size[short] += b - a
                    if size[short] >= BLOCK_WORDS:
                        yield row(short)
    for short, own in open_.items():
        if own:
            yield row(short)


def blocks(benchmark: DataFrame, rate: float) -> Iterator[Block]:
    """The benchmark in blocks of bounded size; tasks hash and pack the items, the driver joins what is packed small."""
    rows = in_arrow(benchmark.select("item_id", "text").filter(F.col("text").isNotNull()), lambda batches: _packed(batches, rate), "short boolean, ids array<long>, sizes array<long>, words binary")
    open_: dict[bool, tuple[list, list[np.ndarray]]] = {True: ([], []), False: ([], [])}
    for r in rows.toLocalIterator():
        ids, items = open_[r.short]
        ids += r.ids
        items += np.split(np.frombuffer(r.words, np.uint64), np.cumsum(r.sizes)[:-1])
        if sum(map(len, items)) >= BLOCK_WORDS:
            yield Block(ids, items, rate)
            open_[r.short] = ([], [])
    for ids, items in open_.values():
        if items:
            yield Block(ids, items, rate)


def _scans(docs: DataFrame, benchmark: DataFrame, rate: float, scan: Callable[[DataFrame, list[Broadcast]], DataFrame], onward: bool) -> Iterator[DataFrame]:
    """``scan(docs, sent)`` for the blocks of each scan; with ``onward`` over what the last one gave.

    With several scans each result but the last is written before the next
    blocks are sent, and its own are taken back: one scan's blocks are live.
    """
    found = blocks(benchmark, rate)
    own = list(itertools.islice(found, SCAN_BLOCKS))
    while own:
        sent = [docs.sparkSession.sparkContext.broadcast(b) for b in own]
        made, own = scan(docs, sent), list(itertools.islice(found, SCAN_BLOCKS))
        if own:
            made = settle(made)
            for b in sent:
                b.destroy()
        docs = made if onward else docs
        yield made


def _match(docs: DataFrame, sent: list[Broadcast]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = symbols(part.column("text"))
                for own in sent:
                    rows = own.value.search(*words)
                    if rows:
                        text, item, distance, first, last = zip(*rows)
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(pa.array(text)), pa.array([own.value.ids[n] for n in item], pa.int64()), pa.array(distance, pa.int32()), pa.array(first, pa.int64()), pa.array(last, pa.int64())],
                            ["doc_id", "item_id", "distance", "first_word", "last_word"],
                        )

    return in_arrow(docs.select("doc_id", "text"), run, SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id, item_id, distance, first_word, last_word``: each item found in each document.

    Word positions count normalised words that are not empty.
    """
    found = docs.sparkSession.createDataFrame([], SCHEMA)
    for part in _scans(docs, benchmark, rate, _match, False):
        found = found.unionByName(part)
    return found


def _kept(docs: DataFrame, sent: list[Broadcast]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, keep = symbols(part.column("text")), np.ones(part.num_rows, bool)
                for own in sent:
                    keep[[r[0] for r in own.value.search(*words)]] = False
                yield part.filter(pa.array(keep))

    return in_arrow(docs, run, docs.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without the documents in which an item was found; a null ``doc_id`` is judged by its own text."""
    for docs in _scans(docs, benchmark, rate, _kept, True):  # noqa: B007
        pass
    return docs
