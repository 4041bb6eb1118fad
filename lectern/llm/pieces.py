"""SentencePiece encoding and decoding through tables of distinct chunks.

Spaces become whitespace markers and a marker goes before the text.  No piece
of the vocabulary has a marker behind another character, so no piece crosses
from one marked word into the next: a text is a sequence of chunks, each a run
of markers and the characters up to the next marker.  The chunks of a slice of
texts are dictionary-encoded, each distinct one is segmented once, and the
table's ids are joined back to the chunks by position.  A worker keeps the
table from slice to slice, in two generations of bounded size.

A vocabulary that breaks that condition (pieces over several words, another
normalisation) is used on whole texts, with the same results.

A null text counts as empty; an empty text has no ids and hashes like the empty
string.  A text without white space is one chunk whatever its length; it takes
memory in proportion to it, and chunks of more than ``LONG`` characters stay
out of the table kept.  Each input row gives one output row, repeated and null
``doc_id``s included; columns besides ``doc_id`` and ``text`` are ignored.  An
empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from lectern.llm.bpe import Pieces, spread
from lectern.llm.spark import in_arrow
from lectern.llm.words import slices

#: The whitespace marker.
MARK = "▁"
#: Characters of the longest chunk that a worker remembers; chunks and ids of one generation.
LONG, KEPT_CHUNKS, KEPT_IDS = 200, 200_000, 2_000_000


class Table:
    """Distinct chunks of one generation and their ids."""

    def __init__(self):
        self.row: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rows of new entries."""
        first = len(self.size)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])
        return np.arange(first, len(self.size))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, and the number of each."""
        size = self.size[rows]
        return self.ids[spread(self.start[rows], size)], size

    def full(self) -> bool:
        return len(self.size) > KEPT_CHUNKS or len(self.ids) > KEPT_IDS


class SentencePieces:
    """A model file, its pieces and the chunks seen so far."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.is_byte = np.array([self.model.is_byte(i) for i in range(n)])
        special = np.array([self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) for i in range(n)])
        # what only the library can decode at a text's start, and anywhere
        self.odd_first, self.odd = special | self.is_byte, special
        self.table = Pieces([bytes([int(p[1:-1], 16)]) if b else p.replace(MARK, " ").encode() for p, b in zip(pieces, self.is_byte.tolist())])
        self.decimal = Pieces([b"%d," % i for i in range(n)])
        self.chunked = self._plain_markers() and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.mark = self.model.piece_to_id(MARK)
        self.young, self.old = Table(), Table()

    def _plain_markers(self) -> bool:
        """Whether the model changes nothing in a text but to put markers for spaces and one before it."""
        probe = "  a  Åﬁ b\t "
        return self.model.normalize(probe) == MARK + probe.replace(" ", MARK)

    def _segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks without their first marker, which the model puts back, and the number of each."""
        found = [ids if chunk else [self.mark] for chunk, ids in zip(chunks, self.model.encode(chunks, num_threads=1))]
        size = np.array([len(ids) for ids in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size

    def _rows(self, distinct: list[str]) -> np.ndarray:
        """Row of the table of each distinct chunk; what is not there is segmented."""
        known, before = self.young.row, self.old.row
        rows = np.array([known.get(c, -1) for c in distinct], np.int64)
        new = np.flatnonzero(rows < 0)
        old = np.array([before.get(distinct[i], -1) for i in new.tolist()], np.int64)
        for at, entries in ((new[old >= 0], lambda at: self.old.take(old[old >= 0])), (new[old < 0], lambda at: self._segment([distinct[i] for i in at.tolist()]))):
            if len(at):
                rows[at] = added = self.young.add(*entries(at))
                known.update((distinct[i], k) for i, k in zip(at.tolist(), added.tolist()) if len(distinct[i]) <= LONG)
        return rows

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts, each without its first marker, and their number in each text."""
        spaced = pc.replace_substring(texts, MARK, " ")
        lists = pc.split_pattern(spaced, " ")
        flat, off = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        off = off - off[0]
        some = pc.binary_length(spaced).to_numpy(zero_copy_only=False) > 0
        filled = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        # a chunk ends with each filled part and with the last part of a text
        ends = filled.copy()
        ends[off[1:] - 1] = some
        at = np.flatnonzero(ends)
        text = np.repeat(np.arange(len(texts)), np.diff(off))[at]
        before = np.concatenate([[-1], at[:-1]])
        markers = at - np.maximum(before, off[:-1][text] - 1) - 1  # empty parts right before it in its text
        parts = flat.take(pa.array(at))
        if markers.any():
            parts = pc.binary_join_element_wise(pc.binary_repeat(pa.array([" "] * len(markers), pa.string()), pa.array(markers)), parts, "")
        return parts, np.bincount(text, minlength=len(texts)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        if not self.chunked:
            found = self.model.encode(texts.to_pylist(), num_threads=1)
            size = np.array([len(ids) for ids in found], np.int64)
            return np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size
        if self.young.full():
            self.young, self.old = Table(), self.young
        parts, count = self.chunks(texts)
        coded = parts.dictionary_encode()
        ids, size = self.young.take(self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(count)])])

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """Each text; ids that stand for no text, or bytes that are none, as the library shows them."""
        start = np.cumsum(count) - count
        filled = count > 0
        odd = np.zeros(len(count), bool)
        odd[filled] = self.odd_first[ids[start[filled]]]
        if len(ids):
            odd[np.repeat(np.arange(len(count)), count)[self.odd[ids]]] = True
        out = []
        for k, joined in enumerate(self.table.join(ids, count)):
            try:
                text = None if odd[k] or not self.chunked else joined.removeprefix(b" ").decode()
            except UnicodeDecodeError:
                text = None
            out.append(self.model.decode(ids[start[k] : start[k] + count[k]].tolist()) if text is None else text)
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> SentencePieces:
    return SentencePieces(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<int>`` of every text, without begin and end ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, count = model.encode(part.column("text"))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), ids)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                a = None if not ids.is_valid else ids.values.to_numpy(zero_copy_only=False).astype(np.int64)
                texts.append(None if a is None else model.decode(a, np.array([len(a)]))[0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return in_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode each text and report digests of both.

    ``doc_id, n_tokens, ids_sha256`` (of the decimal ids joined by commas)
    ``, decoded_sha256`` (of the text decoded from those ids).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, n = model.encode(part.column("text"))
                of_ids = [hashlib.sha256(t[:-1]).hexdigest() for t in model.decimal.join(ids, n)]
                of_text = [hashlib.sha256(t.encode()).hexdigest() for t in model.decode(ids, n)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
