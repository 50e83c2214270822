"""Sites and words of sequences in arrays: what match.py runs over Arrow batches.

A batch's pieces are one array of letter masks (a 1, c 2, g 4, t 8; a degenerate letter has several
bits, anything else none).  The masks of four neighbours make a 16-bit word per place, made
once per slice; a site's most telling four letters are a table of those words, so a site
costs one look-up per place, and only the places that pass are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions.sequence import LETTERS, MASK
from ..plans.patterns import best_seed

#: Letters of a slice: its arrays stay in the processor's caches.
SLICE = 1 << 18
_WORD = 4

MASKS = np.zeros(256, dtype=np.uint8)
MASKS[[ord(x) for x in MASK]] = list(MASK.values())
_FITS = {
    "plain": lambda site: [m & site != 0 and m & (m - 1) == 0 and m > 0 for m in range(16)],
    "subset": lambda site: [m > 0 and m & site == m for m in range(16)],
    "overlap": lambda site: [m & site != 0 for m in range(16)],
}


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each row's begin (one more than rows)."""
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, overlap: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, bytes with the next ``overlap`` ones)."""
    for lo in range(0, len(data), SLICE):
        yield lo, data[lo : lo + SLICE + overlap]


class Site:
    """One strand's site: fits[j][mask] says whether a letter may stand at place j.

    mode: as in match.find_sites; key is subset with plain letters only in the site's most telling six places.
    """

    def __init__(self, site: str, errors: int, mode: str):
        modes = ["subset" if mode == "key" else mode] * len(site)
        if mode == "key":
            at, word = best_seed(site, min(6, len(site)))
            modes[at : at + len(word)] = ["plain"] * len(word)
        self.fits = [np.array(_FITS[m](MASK[x])) for m, x in zip(modes, site)]
        self.anything = np.array(_FITS["subset" if mode == "key" else mode](15))
        self.length, self.errors = len(site), errors
        padded = self.fits + [np.ones(16, dtype=bool)] * (_WORD - len(site))
        self.at = min(range(len(padded) - _WORD + 1), key=lambda i: int(np.prod([f.sum() for f in padded[i : i + _WORD]])))
        a, b, c, d = padded[self.at : self.at + _WORD]
        self.table = (a[:, None, None, None] & b[:, None, None] & c[:, None] & d).reshape(-1)
        self._wrong: list[np.ndarray] = []

    @property
    def wrong(self) -> list[np.ndarray]:
        """For each four letters of the site: how many of a word's letters differ; over 60 where one may not stand in a target at all."""
        if not self._wrong:
            own = [np.where(self.anything, 1 - f.astype(np.uint16), 64) for f in self.fits]
            own += [np.zeros(16, dtype=np.uint16)] * (-self.length % _WORD)
            for k in range(0, self.length, _WORD):
                a, b, c, d = own[k : k + _WORD]
                self._wrong.append((a[:, None, None, None] + b[:, None, None] + c[:, None] + d).reshape(-1).astype(np.uint16))
        return self._wrong

    def starts(self, masks: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        """Places below n where the site fits; masks has _WORD more than the letters, none of which fits."""
        n = min(n, len(masks) - _WORD - self.length + 1)
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        if self.errors:
            wrong = self.wrong[0][words[:n]]
            for k, table in enumerate(self.wrong[1:], 1):
                wrong += table[words[_WORD * k : _WORD * k + n]]
            return np.flatnonzero(wrong <= self.errors)
        place = np.flatnonzero(self.table[words[self.at : self.at + n]])
        for j, fits in enumerate(self.fits):
            if not self.at <= j < self.at + _WORD:
                place = place[fits[masks[place + j]]]
        return place


def words_of(masks: np.ndarray) -> np.ndarray:
    """The 16-bit word of each place's four masks (masks ends with _WORD zeros)."""
    m = masks.astype(np.uint16)
    return (m[:-3] << 12) | (m[1:-2] << 8) | (m[2:-1] << 4) | m[3:]


def find(column: pa.Array, sites: list[Site], own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(site number, row, start from 1) of the hits that begin in the first ``own`` letters of a row and lie in it."""
    data, offsets = letters(column)
    reach = max((s.length for s in sites), default=1) + _WORD
    for lo, part in slices(data, reach):
        masks = np.append(MASKS[part], np.zeros(_WORD, dtype=np.uint8))
        words = words_of(masks)
        for k, site in enumerate(sites):
            place = site.starts(masks, words, min(SLICE, len(data) - lo)) + lo
            row = np.searchsorted(offsets, place, side="right") - 1
            inside = (place + site.length <= offsets[row + 1]) & (place - offsets[row] < own[row])
            if inside.any():
                yield k, row[inside], place[inside] - offsets[row[inside]] + 1


class SeedIndex:
    """Words of plain letters to the (site, offset) that have them, for thousands of sites at once."""

    def __init__(self, keys: list[tuple[str, int, int]], width: int):
        self.width = width
        number = np.array([sum("acgt".index(x) << 2 * i for i, x in enumerate(word)) for word, _, _ in keys], dtype=np.int64)
        by = np.argsort(number, kind="stable")
        self.first = np.searchsorted(number[by], np.arange((1 << 2 * width) + 1))
        self.site = np.array([k for _, k, _ in keys], dtype=np.int64)[by]
        self.at = np.array([at for _, _, at in keys], dtype=np.int64)[by]


def error_seeds(site: str, errors: int, width: int = 6, least: int = 4) -> list[tuple[int, str]]:
    """(offset, word) of errors + 1 stretches of a site that don't overlap: with at most that many errors one has none.

    Empty if a stretch would have fewer than ``least`` telling letters: such words are at most places.
    """
    telling = [i for i, x in enumerate(site) if x != "n"]
    n = errors + 1
    if len(telling) < n * least:
        return []
    cuts = [0, *(telling[len(telling) * k // n] for k in range(1, n)), len(site)]
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        at, word = best_seed(site[lo:hi], min(width, hi - lo))
        if np.prod([float(MASK[x].bit_count()) for x in word]) > 4 ** (len(word) - least + 1):
            return []
        out.append((lo + at, word))
    return out


def find_by_pieces(column: pa.Array, sites: list[Site], indexes: list[SeedIndex], own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(site number, row, start from 1) of all hits of sites with errors whose error_seeds are in the indexes.

    A start that several of a site's seeds point to is compared once; comparing ends at the first error too many.
    """
    data, offsets = letters(column)
    reach = max(s.length for s in sites)
    length, errors = np.array([s.length for s in sites]), np.array([s.errors for s in sites], dtype=np.uint8)
    wrong_at = np.zeros((len(sites), reach, 16), dtype=np.uint8)
    for k, s in enumerate(sites):
        wrong_at[k, : s.length] = np.where(s.anything, 1 - np.array(s.fits, dtype=np.uint8), 100)
    for lo in range(0, len(data), SLICE):
        front = max(0, lo - reach)  # a seed may lie before the slice's first start's own
        masks = MASKS[data[front : lo + SLICE + reach]]
        keys = []
        for index in indexes:
            number, clean = numbers_of(masks, index.width)
            place = np.flatnonzero(clean)
            first, last = index.first[number[place]], index.first[number[place] + 1]
            n = last - first
            place, first, n = place[n > 0], first[n > 0], n[n > 0]
            ends = np.cumsum(n)
            entry = np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
            start = np.repeat(place, n) - index.at[entry] + front
            ok = (start >= lo) & (start < lo + SLICE)
            keys.append(index.site[entry][ok] * SLICE + (start[ok] - lo))
        key = np.unique(np.concatenate(keys))
        site, start = key // SLICE, key % SLICE + lo
        row = np.searchsorted(offsets, start, side="right") - 1
        ok = (start + length[site] <= offsets[row + 1]) & (start - offsets[row] < own[row])
        site, start, row = site[ok], start[ok], row[ok]
        wrong = np.zeros(len(site), dtype=np.uint8)
        done = []
        for j in range(reach):
            over = length[site] == j
            if over.any():
                done.append((site[over], row[over], start[over]))
                go = ~over
                site, start, row, wrong = site[go], start[go], row[go], wrong[go]
            wrong = wrong + wrong_at[site, j, masks[start - front + j]]
            go = wrong <= errors[site]
            site, start, row, wrong = site[go], start[go], row[go], wrong[go]
        done.append((site, row, start))
        site, row, start = (np.concatenate(x) for x in zip(*done))
        yield site, row, start - offsets[row] + 1


class Matrix:
    """A weight matrix of integer cells (a, c, g, t for each place) and the score that a window needs.

    Windows are tried by the four neighbouring places that rule out most: the best that a window can still
    reach is their sum and the greatest cells of all other places.  Those that pass are summed over the other places, the most telling
    first, and leave as soon as the greatest cells of the places to come can't make up for what they lack.
    """

    def __init__(self, rows: list[list[int]], need: int):
        self.rows, self.need, self.length = np.array(rows, dtype=np.int64), need, len(rows)
        self.cell = np.full((self.length, 16), -(1 << 40), dtype=np.int64)  # by letter mask: letters but acgt have no score
        self.cell[:, [1, 2, 4, 8]] = self.rows
        top, telling = self.rows.max(axis=1), self.rows.max(axis=1) - self.rows.mean(axis=1)
        self.at = max(range(max(1, self.length - _WORD + 1)), key=lambda i: telling[i : i + _WORD].sum())
        four = [self.cell[k] if k < self.length else np.zeros(16, dtype=np.int64) for k in range(self.at, self.at + _WORD)]
        a, b, c, d = four
        self.sums = np.maximum((a[:, None, None, None] + b[:, None, None] + c[:, None] + d).reshape(-1), -(1 << 40))
        others = [k for k in range(self.length) if not self.at <= k < self.at + _WORD]
        self.order = sorted(others, key=lambda k: -telling[k])
        self.rest = np.append(np.cumsum(top[self.order][::-1])[::-1], 0)  # the most that places from here on can add
        self.able = self.sums + self.rest[0] >= need

    def hits(self, masks: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places below n whose window reaches the score, and their scores; masks as in Site.starts."""
        n = min(n, len(masks) - _WORD - self.length + 1)
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        place = np.flatnonzero(self.able[words[self.at : self.at + n]])
        score = self.sums[words[self.at + place]]
        for j, rest in zip(self.order, self.rest[1:]):
            score = score + self.cell[j][masks[place + j]]
            go = score + rest >= self.need
            place, score = place[go], score[go]
        return place, score


def find_matrices(column: pa.Array, matrices: list[Matrix], own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(matrix number, row, start from 1, score) of the windows that begin in the first ``own`` letters of a row and lie in it."""
    data, offsets = letters(column)
    reach = max((m.length for m in matrices), default=1) + _WORD
    for lo, part in slices(data, reach):
        masks = np.append(MASKS[part], np.zeros(_WORD, dtype=np.uint8))
        words = words_of(masks)
        for k, matrix in enumerate(matrices):
            place, score = matrix.hits(masks, words, min(SLICE, len(data) - lo))
            place = place + lo
            row = np.searchsorted(offsets, place, side="right") - 1
            inside = (place + matrix.length <= offsets[row + 1]) & (place - offsets[row] < own[row])
            if inside.any():
                yield k, row[inside], place[inside] - offsets[row[inside]] + 1, score[inside]


_BASE = np.full(16, 255, dtype=np.uint8)
_BASE[[1, 2, 4, 8]] = range(4)


def numbers_of(masks: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The little-endian base-4 number of each place's word, and whether all its letters are plain."""
    n = len(masks) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    base = _BASE[masks]
    number, clean = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for j in range(width):
        here = base[j : j + n]
        clean &= here < 4
        number |= (here & 3).astype(np.int64) << 2 * j
    return number, clean


def find_by_index(column: pa.Array, sites: list[Site], indexes: list[SeedIndex], own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(site number, row, start from 1) of all hits of exact sites, each seed looked up once per place."""
    data, offsets = letters(column)
    reach = max(s.length for s in sites)
    length = np.array([s.length for s in sites])
    fits = np.ones((len(sites), int(length.max()), 16), dtype=bool)
    for k, s in enumerate(sites):
        fits[k, : s.length] = s.fits
    for lo, part in slices(data, 2 * reach):
        masks = MASKS[part]
        for index in indexes:
            number, clean = numbers_of(masks, index.width)
            place = np.flatnonzero(clean)
            first, last = index.first[number[place]], index.first[number[place] + 1]
            n = last - first
            place, first, n = place[n > 0], first[n > 0], n[n > 0]
            ends = np.cumsum(n)
            entry = np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
            site = index.site[entry]
            start = np.repeat(place, n) - index.at[entry] + lo
            # A start belongs to the slice that it lies in; seeds in the overlap find it too.
            row = np.searchsorted(offsets, start, side="right") - 1
            ok = (start >= lo) & (start < lo + SLICE)
            row = np.where(ok, row, 0)
            ok &= (start + length[site] <= offsets[row + 1]) & (start - offsets[row] < own[row])
            site, start, row = site[ok], start[ok], row[ok]
            for j in range(int(length.max())):
                more = j < length[site]
                good = ~more
                good[more] = fits[site[more], j, masks[start[more] - lo + j]]
                site, start, row = site[good], start[good], row[good]
            yield site, row, start - offsets[row] + 1


def plain_words(numbers: np.ndarray, width: int) -> pa.Array:
    """Base-4 numbers as words."""
    text = np.frombuffer(b"acgt", dtype=np.uint8)[(numbers[:, None] >> 2 * np.arange(width)) & 3]
    return pa.array([x.tobytes().decode() for x in np.ascontiguousarray(text)], type=pa.string())


def count_words(batches, width: int):
    """(word, n) of every clean word in the pieces, summed over a task if there are few of them, else over a batch."""
    dense = np.zeros(1 << 2 * width, dtype=np.int64) if width <= 10 else None
    for b in batches:
        own = b.column("own").to_numpy()
        data, offsets = letters(b.column("piece"))
        for lo, part in slices(data, width - 1):
            number, clean = numbers_of(MASKS[part], width)
            place = np.flatnonzero(clean[:SLICE])
            row = np.searchsorted(offsets, place + lo, side="right") - 1
            ok = (place + lo + width <= offsets[row + 1]) & (place + lo - offsets[row] < own[row])
            found = number[place[ok]]
            if dense is not None:
                dense += np.bincount(found, minlength=len(dense))
            else:
                value, n = np.unique(found, return_counts=True)
                yield value, n
    if dense is not None:
        value = np.flatnonzero(dense)
        yield value, dense[value]


_LETTER = np.zeros(256, dtype=np.uint16)
_LETTER[[ord(x) for x in LETTERS]] = range(len(LETTERS))


def distinct_words(batches, width: int):
    """The distinct words of at most five IUPAC letters in a task's pieces."""
    seen = np.zeros(1 << 4 * width, dtype=bool)
    for b in batches:
        own = b.column("own").to_numpy()
        data, offsets = letters(b.column("piece"))
        for lo, part in slices(data, width - 1):
            code = _LETTER[part].astype(np.int64)
            n = min(SLICE, len(code) - width + 1)
            if n <= 0:
                continue
            number = sum(code[j : j + n] << 4 * (width - 1 - j) for j in range(width))
            place = np.arange(lo, lo + n)
            row = np.searchsorted(offsets, place, side="right") - 1
            seen[number[(place + width <= offsets[row + 1]) & (place - offsets[row] < own[row])]] = True
    number = np.flatnonzero(seen)
    text = np.frombuffer(LETTERS.encode(), dtype=np.uint8)[(number[:, None] >> 4 * np.arange(width - 1, -1, -1)) & 15]
    return [x.tobytes().decode() for x in np.ascontiguousarray(text)]


def codon_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the whole codons of frame 1 (aaa 0, aac 1, ...; 64 with other letters), and where each row's begin (one more than rows)."""
    data, offsets = letters(column)
    size = np.diff(offsets)
    n = size // 3
    edge = np.append(0, np.cumsum(n)).astype(np.int64)
    first = np.repeat(offsets[:-1] - 3 * edge[:-1], n) + 3 * np.arange(int(edge[-1]))
    base = _BASE[MASKS[data]]
    a, b, c = (base[first + j] for j in range(3))
    return np.where((a < 4) & (b < 4) & (c < 4), (a & 3) << 4 | (b & 3) << 2 | c & 3, 64).astype(np.uint8), edge


def find_orfs(column: pa.Array, code: np.ndarray, which: tuple[int, ...], least: int, require_met: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """(frame, row, first residue from 1, peptide) of the stretches between stops, by row and place.

    code: the residue (a byte) of each of the 64 codons, aaa aac aag aat aca ...; last, that of a codon with other letters.
    """
    data, offsets = letters(column)
    size = np.diff(offsets)
    base = _BASE[MASKS[data]]
    for down in (False, True):
        frames = [f for f in which if (f > 3) == down]
        if not frames or not len(data):
            continue
        if down:  # each row turned round; letters are taken for their complements
            place = np.arange(len(data))
            row = np.repeat(np.arange(len(size)), size)
            base = np.where(base < 4, 3 - base, base)[offsets[row] + offsets[row + 1] - 1 - place]
        number = np.full(len(base), 64, dtype=np.uint8)
        plain = (base[:-2] < 4) & (base[1:-1] < 4) & (base[2:] < 4)
        number[: max(0, len(base) - 2)] = np.where(plain, (base[:-2] & 3) << 4 | (base[1:-1] & 3) << 2 | base[2:] & 3, 64)
        residue = code[number]
        for frame in frames:
            n = np.maximum(0, (size - (frame - 1) % 3) // 3)  # whole codons of each row
            ends = np.cumsum(n)
            row = np.repeat(np.arange(len(n)), n)
            protein = residue[offsets[row] + (frame - 1) % 3 + 3 * (np.arange(len(row)) - (ends - n)[row])]
            stop = np.flatnonzero(protein == ord("*"))
            # A stretch begins at each row's start and after each stop; it ends at the next stop or the row's end.
            begin, kind = np.concatenate([ends - n, stop + 1]), np.concatenate([np.zeros(len(n), dtype=bool), np.ones(len(stop), dtype=bool)])
            own = np.concatenate([np.arange(len(n)), row[stop]])
            order = np.lexsort((begin, own))
            begin, kind, own = begin[order], kind[order], own[order]
            end = np.where(np.append(own[1:] == own[:-1], False), np.append(begin[1:], 0) - 1, ends[own])
            if require_met:
                met = np.append(np.flatnonzero(protein == ord("M")), len(protein))
                begin = np.where(kind, met[np.searchsorted(met, begin)], begin)
            good = np.flatnonzero(end - begin >= max(least, 1))
            begin, end, own = begin[good], end[good], own[good]
            length = end - begin
            edge = np.append(0, np.cumsum(length))
            text = protein[np.repeat(begin - edge[:-1], length) + np.arange(int(edge[-1]))]
            peptides = pa.Array.from_buffers(pa.large_string(), len(own), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))])
            yield frame, own, begin - (ends - n)[own] + 1, peptides
