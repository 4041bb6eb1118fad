"""Arrow/numpy tokenisation shared by the operators that work on word sequences.

A word is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``, which is
what Arrow's ``ascii_split_whitespace`` separates.  Texts are processed in
slices of a few MB, so memory does not depend on the batch size Spark chose.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the machine: workers live on between tasks, two or more beside each executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts reach ``limit`` bytes; a longer text is a slice of its own."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in one array, and the offsets of each text's words (nulls have none)."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, off = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    keep = pc.greater(pc.binary_length(flat), 0)
    if pc.all(keep).as_py() is False:
        at = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
        flat, off = flat.filter(keep), at[off]
    return flat, off


#: Keys of the hash of words: the usual one, and that of a second, independent hash.
KEYS = ("0123456789123456", "6543219876543210")


def hash_words(flat: pa.Array, key: str = KEYS[0]) -> np.ndarray:
    """64-bit hash of each word; only distinct words are hashed."""
    if len(flat) == 0:
        return np.zeros(0, np.uint64)
    coded = flat if isinstance(flat, pa.DictionaryArray) else flat.dictionary_encode()
    known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), hash_key=key, categorize=False)
    return known[coded.indices.to_numpy()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place."""
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` items of the flat array; runs over a text's end are included and must be masked.

    Doubling: the hash of 2k items is made of two hashes of k items, so the
    cost is logarithmic in ``n``.
    """
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, have, power, width = None, 0, h, 1
    left = n
    while left:
        if left & 1:
            if out is None:
                out, have = power.copy(), width
            else:
                m = len(h) - have - width + 1
                out = mix(out[:m] * np.uint64(0x9E3779B97F4A7C15) + power[have : have + m] + np.uint64(have))
                have += width
        left >>= 1
        if left:
            m = len(power) - width
            power = mix(power[:m] * np.uint64(0xD6E8FEB86659FD93) + power[width : width + m] + np.uint64(width))
            width *= 2
    return out
