"""Bags of words: the distinct words of each text and how often each has them, exactly, in arrays."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .common import word_spans

#: Bytes beyond which a single text is counted window by window, so that memory follows its distinct words.
LONG = 8 << 20


class Bags(NamedTuple):
    """terms: distinct words of the slice; then a row for each text and word, by text: text, term (its place), count; n: all words of each text."""

    terms: pa.Array
    text: np.ndarray
    term: np.ndarray
    count: np.ndarray
    n: np.ndarray


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> pa.Array:
    """The words as a binary array."""
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[table[data]]))])


def _windows(data: np.ndarray, table: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Parts of a text that end after a byte that is in no word."""
    lo = 0
    while lo < len(data):
        hi = lo + size
        while hi < len(data):
            apart = np.flatnonzero(~table[data[hi - 1 : hi - 1 + size]])
            if len(apart):
                hi += int(apart[0])
                break
            hi += size
        yield data[lo : min(hi, len(data))]
        lo = hi


def bags(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Bags:
    """data: bytes of texts, offsets: where each begins (one more than texts), table: which bytes are in words."""
    if len(offsets) == 2 and len(data) > LONG:
        terms, count = pa.array([], type=pa.binary()), np.zeros(0, dtype=np.int64)
        for part in _windows(data, table, LONG):
            starts, ends, _ = word_spans(part, np.array([0, len(part)]), table)
            found = _words(part, starts, ends, table).value_counts()
            coded = pa.concat_arrays([terms, found.field("values")]).dictionary_encode()
            count = np.bincount(coded.indices.to_numpy(), np.append(count, found.field("counts").to_numpy()), len(coded.dictionary)).astype(np.int64)
            terms = coded.dictionary
        return Bags(terms, np.zeros(len(terms), dtype=np.int64), np.arange(len(terms)), count, np.array([count.sum()]))
    starts, ends, first = word_spans(data, offsets, table)
    coded = _words(data, starts, ends, table).dictionary_encode()
    n, most = np.diff(first), max(1, len(coded.dictionary))
    key, count = np.unique(np.repeat(np.arange(len(n)), n) * most + coded.indices.to_numpy(), return_counts=True)
    return Bags(coded.dictionary, key // most, key % most, count, n)
