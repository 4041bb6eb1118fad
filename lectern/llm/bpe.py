"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array.  A round looks up every
adjacent pair by binary search over the sorted pair keys, takes the lowest
rank of each word, and merges that pair wherever it occurs in the word (left
to right, without overlap).  Words with no known pair leave the array.  Only
words not seen before by the worker are merged; a cache of two generations of
bounded size keeps those that recur.

A null text counts as empty; an empty text has no tokens and hashes like the
empty string.  Each input row gives one output row, repeated ``doc_id``s and
null ``doc_id``s included; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from lectern.llm.spark import in_arrow
from lectern.llm.words import slices

#: The split pattern of this family of vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ɏ]", "[.,;:!?]"
#: Pre-tokens that are merged at once.
MERGED = 20_000
#: Pre-tokens in a generation of the cache; bytes of text that are encoded at once.
CACHE_WORDS, SLICE = 100_000, 1 << 20
_NONE = np.int32(2**31 - 1)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    moved = iter(range(256, 512))
    return [chr(b if b in shown else next(moved)) for b in range(256)]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``start[i] .. start[i]+size[i]``."""
    total = int(size.sum())
    first = np.repeat(start - (np.cumsum(size) - size), size)
    return first + np.arange(total)


class Seen:
    """Pre-tokens of one generation of the cache and their ids."""

    def __init__(self, special: np.ndarray):
        self.plain: dict[str, int] = {}  # index of a pre-token
        self.spaced: dict[str, int] = {}  # index of a space and what follows it, up to the next space
        self.ids, self.at, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.add(special, np.ones(len(special), np.int64))

    def add(self, ids: np.ndarray, n: np.ndarray) -> range:
        base, ends = len(self.n), np.cumsum(n)
        self.at = np.concatenate([self.at, len(self.ids) + ends - n])
        self.n = np.concatenate([self.n, n.astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids])
        return range(base, base + len(n))

    def ids_of(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all entries ``index`` in one array, and the number of each."""
        n = self.n[index].astype(np.int64)
        return self.ids[spread(self.at[index], n)], n


class Pieces:
    """Byte strings of all ids, to put together texts from arrays of ids."""

    def __init__(self, table: list[bytes]):
        self.size = np.array([len(p) for p in table], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def join(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        size = self.size[ids]
        flat = self.bytes[spread(self.start[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])].tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]


class ByteBPE:
    """A vocabulary file and its merge tables."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = byte_characters()
        back = {c: b for b, c in enumerate(chars)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pieces = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        pieces |= {i: t.encode() for t, i in self.special.items()}
        table = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.decoded, self.decimal = Pieces(table), Pieces([b"%d," % i for i in range(len(table))])
        self.symbol = np.array([vocab[c] for c in chars], np.int32)
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        space = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
        self.whole = "|".join([rf"\A(?: |\z)| \z|{space} | {space}", *(re.escape(t) for t in self.special)])
        special = np.array(list(self.special.values()), np.int32)
        self.special_at = {t: k for k, t in enumerate(self.special)}
        self.fresh = lambda: Seen(special)
        self.young, self.old = self.fresh(), self.fresh()

    def _places(self, kind: str, found: pa.Array, split) -> np.ndarray:
        """Index of each of the distinct strings ``found``; ``split`` gives the ids of those not seen before."""
        into, before, names = getattr(self.young, kind), getattr(self.old, kind), found.to_pylist()
        at = np.array([into.get(w, -1) for w in names], np.int64)
        new = np.flatnonzero(at < 0)
        old = np.array([before.get(names[i], -1) for i in new.tolist()], np.int64)
        again, new = new[old >= 0], new[old < 0]
        for own, ids_and_counts in ((again, lambda: self.old.ids_of(old[old >= 0])), (new, lambda: split(found.take(pa.array(new))))):
            if len(own):
                at[own] = places = self.young.add(*ids_and_counts())
                into.update(zip([names[i] for i in own.tolist()], places))
        return at

    def _plain(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.merge([w.encode() for w in found.to_pylist()])

    def _spaced(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each string, and their numbers."""
        # a word, with a mark behind it or not, is what the pattern's branches for letters and for marks take
        simple = pc.match_substring_regex(found, rf"\A{LETTERS}+{MARKS}?\z").to_numpy(zero_copy_only=False)
        words = pa.concat_arrays([found.filter(pa.array(simple))])
        marked = pc.match_substring_regex(words, rf"{MARKS}\z").to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.full(int(size.sum()) + len(size), ord(" "), np.uint8)
        start = np.cumsum(size + 1) - size - 1
        if len(words):
            data[spread(start + 1, size)] = np.frombuffer(words.buffers()[2], np.uint8)[spread(words.offset + np.cumsum(size) - size, size)]
        first = np.cumsum(1 + marked) - 1 - marked
        sizes = np.ones(len(size) + int(marked.sum()), np.int64)
        sizes[first] = size + 1 - marked
        ids, n = self.merge_flat(data, sizes)
        n = np.add.reduceat(n, first) if len(first) else n
        # everything else goes through the pattern
        split = [self.split.findall(" " + w) for w in found.filter(pa.array(~simple)).to_pylist()]
        more, k = self.merge([x.encode() for w in split for x in w])
        k = np.diff(np.concatenate([[0], np.cumsum(k)])[np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)])
        count = np.empty(len(found), np.int64)
        count[simple], count[~simple] = n, k
        out, at = np.empty(len(ids) + len(more), np.int32), np.cumsum(count) - count
        out[spread(at[simple], n)], out[spread(at[~simple], k)] = ids, more
        return out, count

    def merge(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each word."""
        return self.merge_flat(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64))

    def merge_flat(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge``, for the bytes of all words in one array and the words' sizes; ``MERGED`` words at a time."""
        parts, ends = [], np.concatenate([[0], np.cumsum(size)])
        for a in range(0, len(size), MERGED):
            b = min(a + MERGED, len(size))
            parts.append(self._merge(data[ends[a] : ends[b]], size[a:b]))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _merge(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sym = self.symbol[data]
        word = np.repeat(np.arange(len(size), dtype=np.int32), size)
        done_sym, done_word = [], []
        while len(sym):
            rank = np.full(len(sym), _NONE)
            key = sym[:-1].astype(np.int64) << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = (self.key[at] == key) & (word[:-1] == word[1:])
            rank[:-1][ok] = self.rank[at[ok]]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            span = np.diff(np.concatenate([first, [len(sym)]]))
            over = np.repeat(least == _NONE, span)
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank = sym[~over], word[~over], rank[~over]
                least, span = least[least != _NONE], span[least != _NONE]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, span)
            # of neighbouring hits (a pair like "aa" in "aaa"), every second one merges
            run = np.flatnonzero(hit)
            head = np.concatenate([[True], (np.diff(run) > 1) | (word[run[1:]] != word[run[:-1]])])
            since = run - np.repeat(run[head], np.diff(np.concatenate([np.flatnonzero(head), [len(run)]])))
            take = run[since % 2 == 0]
            sym[take] = self.merged[rank[take]]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(size)).astype(np.int64)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cache index of each piece of all texts (nulls count as empty), and their number in each text.

        Where no space touches other white space or an end of the text, no
        pre-token crosses into the next space, so what stands between spaces is
        split each by itself, once for each distinct piece of all such texts.
        """
        texts = pc.fill_null(texts, "").cast(pa.string())
        if len(self.young.n) > CACHE_WORDS:
            self.young, self.old = self.fresh(), self.young
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
        flat, off = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        off = off - off[0]
        behind = np.ones(len(flat), bool)
        behind[off[:-1]] = False
        lead, rest = iter(flat.filter(pa.array(~behind)).to_pylist()), flat.filter(pa.array(behind)).dictionary_encode()
        # pre-tokens of texts split as a whole, and of the piece before a text's first space
        head = [self._whole(t) if w else self.split.findall(next(lead)) for w, t in zip(whole.tolist(), (texts[i].as_py() if w else None for i, w in enumerate(whole.tolist())))]
        self._places("plain", pa.array({x for h in head for x in h if isinstance(x, str)}, pa.string()), self._plain)
        plain = self.young.plain
        first = np.array([plain[x] if isinstance(x, str) else x for h in head for x in h], np.int64)
        n_first, n_rest = np.array([len(h) for h in head], np.int64), np.zeros(len(texts), np.int64)
        n_rest[~whole] = np.diff(off) - 1
        known = self._places("spaced", rest.dictionary, self._spaced)
        count = n_first + n_rest
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        out[spread(at, n_first)] = first
        out[spread(at + n_first, n_rest)] = known[rest.indices.to_numpy()] if len(known) else 0
        return out, count

    def _whole(self, text: str) -> list[str | int]:
        """Pre-tokens; a special token as its index."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.split.findall(text)
        out: list[str | int] = []
        for part in self.cut.split(text):
            out += [self.special_at[part]] if part in self.special else self.split.findall(part)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        word, count = self.words(texts)
        return self._ids(word, count)

    def _ids(self, word: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, n = self.young.ids_of(word)
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(count)])])

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each text; byte runs that are not UTF-8 become U+FFFD."""
        return [t.decode("utf-8", "replace").encode() for t in self.decoded.join(ids, count)]


@functools.lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<int>`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, count = bpe.encode(part.column("text"))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), ids)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                a = None if not ids.is_valid else ids.values.to_numpy(zero_copy_only=False).astype(np.int64)
                texts.append(None if a is None else bpe.decode(a, np.array([len(a)]))[0].decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return in_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode each text and report digests of both.

    ``doc_id, n_tokens, ids_sha256`` (of the decimal ids joined by commas)
    ``, decoded_sha256`` (of the text decoded from those ids).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, n = bpe.encode(part.column("text"))
                of_ids = [hashlib.sha256(t[:-1]).hexdigest() for t in bpe.decimal.join(ids, n)]
                of_text = [hashlib.sha256(t).hexdigest() for t in bpe.decode(ids, n)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
