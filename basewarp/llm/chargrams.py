"""Hashed character n-grams of many texts at once, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_tables: list[np.ndarray] = []


def _alpha() -> np.ndarray:
    """Which code points are letters."""
    if not _tables:
        _tables.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _tables[0]


class Grams:
    """Lower-cased texts one after another, each between blanks, everything but letters as a blank.

    codes: code points; offsets: where each text begins (one more than texts); lettered: which texts have a letter.
    bare: the texts are windows of such a text already.
    """

    def __init__(self, texts: list[str], bare: bool = False):
        texts = texts if bare else [f" {t.lower()} " for t in texts]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _alpha()[codes]
        self.codes = np.where(letter, codes, np.uint32(32))
        self.lettered = np.add.reduceat(letter.astype(np.int64), self.offsets[:-1]) > 0 if texts else np.zeros(0, dtype=bool)

    def hashed(self, order: int, bits: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The bucket of the n-gram at each position lo to hi; 2**bits where it would cross a text's end."""
        hi = len(self.codes) if hi is None else hi
        c = self.codes[lo : min(hi + order - 1, len(self.codes))]
        c = np.concatenate([c, np.full(hi - lo + order - 1 - len(c), 32, dtype=np.uint32)])
        h = c[: hi - lo] * np.uint32(0x9E3779B1)
        for k in range(1, order):
            h = (h ^ (h >> np.uint32(15)) ^ c[k : k + hi - lo]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        out = (h >> np.uint32(32 - bits)).astype(np.int32)
        for k in range(1, order):
            at = self.offsets[1:] - k
            at = at[(at >= lo) & (at < hi)]
            out[at - lo] = 1 << bits
        return out


def split_texts(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``limit`` characters: first index and texts."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def gram_runs(texts: list[str], orders: tuple[int, ...], limit: int = 1 << 20) -> Iterator[tuple[int, int, Grams, list[int]]]:
    """First text, number of texts, their n-grams, and which of the orders count there.  A long text comes in windows, for
    each order with the overlap that its n-grams need, so that a text of any length needs memory for a window only."""
    for at, part in split_texts(texts, limit):
        if len(part) > 1 or len(part[0]) <= 2 * limit:
            yield at, len(part), Grams(part), list(range(len(orders)))
            continue
        whole = f" {part[0].lower()} "
        for k, order in enumerate(orders):
            for lo in range(0, len(whole), limit):
                yield at, 1, Grams([whole[lo : lo + limit + order - 1]], bare=True), [k]


def sparse_counts(grams: Grams, order: int, bits: int, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, bucket, n) of the buckets that each text has, sorted; in steps, so that a very long text needs no more memory
    (a text over a step's edge has its counts in both)."""
    for lo in range(0, len(grams.codes), step):
        hi = min(lo + step, len(grams.codes))
        bucket = grams.hashed(order, bits, lo, hi)
        key = np.searchsorted(grams.offsets, np.arange(lo, hi), side="right") - 1 if len(grams.offsets) > 2 else np.zeros(hi - lo, dtype=np.int64)
        key = key[bucket < 1 << bits] << bits | bucket[bucket < 1 << bits]
        key.sort()
        if len(key):
            last = np.append(np.flatnonzero(key[1:] != key[:-1]), len(key) - 1)
            yield key[last] >> bits, key[last] & (1 << bits) - 1, np.diff(last, prepend=-1)


def segment_sums(grams: Grams, order: int, bits: int, rows: np.ndarray) -> np.ndarray:
    """Per text the sum of count times rows[bucket] over its buckets: the sparse matrix of counts times the matrix of rows."""
    width = max(1, rows.shape[1])
    out = np.zeros((len(grams.offsets) - 1, rows.shape[1]))
    for text, bucket, n in sparse_counts(grams, order, bits):
        for lo in range(0, len(text), max(1 << 12, (1 << 19) // width)):  # a bound of memory at many columns
            part = slice(lo, lo + max(1 << 12, (1 << 19) // width))
            own = text[part]
            first = np.append(0, np.flatnonzero(own[1:] != own[:-1]) + 1)
            out[own[first]] += np.add.reduceat(rows[bucket[part]] * n[part, None], first, axis=0)
    return out
