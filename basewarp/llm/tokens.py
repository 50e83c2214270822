"""Token ids of whole texts by the tokenizers library, with each distinct piece of a text encoded once.

A pre-tokenizer cuts a text into pieces that are encoded without regard to each other.  Here
the cuts of two kinds of tokenizer file are found in arrays of bytes:

* byte level: runs of letters, of numbers, of other characters, each with one blank before
  it; of white space before such a run all but the last character are a piece;
* words: runs of letters, single numbers, runs of other characters; white space is dropped.

Which class a character has is asked of the library itself, once per character.  Where a cut
depends on more than classes (apostrophes; for words also characters that normalisation
joins, reorders or turns into several) the run between white space is one piece.  Strings of
added tokens are pieces too.  The distinct pieces of a slice come from Arrow; those not yet known
to this worker are encoded by the library (single-class pieces by its model, others by the
whole tokenizer), and the ids of all texts are gathered from flat arrays.

A file of any other kind has its texts encoded whole.  A text beyond the size of a slice goes
in windows that end before a blank between ASCII letters.  Bytes that aren't UTF-8 count as
U+FFFD.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import chunks, kept, mixed, power

#: Pieces, and bytes of them, kept per worker; beyond, the table starts anew (a bound of memory, not of what is encoded).
KEEP, KEEP_BYTES = 700_000, 48_000_000
#: Bytes of text that are cut at once.
SLICE = 2 << 20
_WHITE, _LETTER, _NUMBER, _OTHER, _JOINED, _UNKNOWN = range(6)

#: Fixed pattern of the word kind.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _kind(spec: dict) -> str | None:
    """byte, word, or None: a file that is not known to cut where this module does."""
    model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    plain_tokens = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", ()))
    if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or spec.get("truncation") or spec.get("padding") or not plain_tokens:
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None and not model.get("end_of_word_suffix"):
        return "byte"
    if pre.get("type") != "Sequence" or not norm or norm.get("type") != "Sequence" or [n["type"] for n in norm["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
        return None
    replace, parts = norm["normalizers"][1], pre["pretokenizers"]
    split = len(parts) == 2 and parts[0]["type"] == "Split" and parts[0]["pattern"] == {"Regex": _WORD_PATTERN} and parts[0]["invert"] and parts[0]["behavior"] == "Removed"
    level = len(parts) == 2 and parts[1]["type"] == "ByteLevel" and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]
    return "word" if split and level and replace == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} else None


def _byte_letters() -> np.ndarray:
    """The character that byte-level vocabularies write for each byte, as UTF-16 units."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = np.zeros(256, dtype="<u2")
    table[shown] = shown
    hidden = np.setdiff1d(np.arange(256), shown)
    table[hidden] = 256 + np.arange(len(hidden))
    return table


def _gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts of flat that begin at ``at``, one after another."""
    ends = np.cumsum(size, dtype=np.int32)
    index = np.repeat(at - (ends - size), size)
    index += np.arange(len(index), dtype=np.int32)
    return flat[index]


_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = 0x9E3779B97F4A7C15


def _parts(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values and where each begins (one more than values)."""
    _, where, data = pieces.buffers()
    offsets = np.frombuffer(where, dtype=np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Places:
    """Pieces to places 0, 1, ... in the order in which they are added: an open-addressed table of 64-bit hashes; what it
    finds is compared byte by byte, so a piece is never taken for another one."""

    def __init__(self, most: int):
        self.mask = np.uint64((1 << max(8, (2 * most).bit_length())) - 1)
        self.hash = np.zeros(int(self.mask) + 1, dtype=np.uint64)
        self.place = np.zeros(int(self.mask) + 1, dtype=np.int32)
        self.data, self.offsets = np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @staticmethod
    def hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * power(_ODD, len(data)), out=sums[1:])
        own = (sums[offsets[1:]] - sums[offsets[:-1]]) * power(pow(_ODD, -1, 1 << 64), len(data) + 1)[offsets[:-1]]
        return mixed(own + np.diff(offsets).astype(np.uint64)) | np.uint64(1)

    def find(self, hashes: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The place of each piece, -1 if it has none."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        open_, slot = np.arange(len(hashes)), hashes & self.mask
        while len(open_):
            there = self.hash[slot]
            hit = there == hashes[open_]
            out[open_[hit]] = self.place[slot[hit]]
            more = ~hit & (there != 0)
            open_, slot = open_[more], slot[more] + np.uint64(1) & self.mask
        found = np.flatnonzero(out >= 0)
        size, place = np.diff(offsets)[found], out[found]
        same = self.offsets[place + 1] - self.offsets[place] == size
        differ = np.flatnonzero(~same)
        if len(differ):
            out[found[differ]] = -1
            found, place, size = found[same], place[same], size[same]
        ends = np.cumsum(size)
        inside = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
        unlike = self.data[inside + np.repeat(self.offsets[place], size)] != data[inside + np.repeat(offsets[found], size)]
        if unlike.any():
            out[found[np.unique(np.repeat(np.arange(len(found)), size)[unlike])]] = -1
        return out

    def add(self, hashes: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Adds pieces that have no place; returns their places."""
        place = np.arange(len(self), len(self) + len(hashes), dtype=np.int32)
        self.offsets = np.append(self.offsets, offsets[1:] + self.offsets[-1])
        self.data = np.append(self.data, data)
        open_, slot = np.arange(len(hashes)), hashes & self.mask
        while len(open_):
            there = self.hash[slot]
            free = there == 0
            self.hash[slot[free]] = hashes[open_[free]]
            self.place[slot[free]] = place[open_[free]]
            # Of several pieces that want one slot the last has it; one with another's very hash is found by nobody.
            more = (self.place[slot] != place[open_]) & (self.hash[slot] != hashes[open_])
            open_, slot = open_[more], slot[more] + np.uint64(1) & self.mask
        return place


class Encoder:
    def __init__(self, path: str, keep: int | None = None, slice_bytes: int = SLICE):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = _kind(spec)
        self.words = self.kind == "word"
        self.added = [t["content"].encode() for t in spec.get("added_tokens", ())]
        names = self.tokenizer.get_vocab()
        self.width = "<u2" if max(names.values()) < 1 << 16 else "<u4"
        self.keep, self.slice_bytes = keep or KEEP, slice_bytes
        # The model alone, for pieces that are already cut and written in byte letters, a line end apart.
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.model.encode_special_tokens = True
        self.letters = _byte_letters()
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.letters_of = np.zeros(max(names.values()) + 1, dtype=np.int64)
        for name, at in names.items():
            self.letters_of[at] = len(name) - len(suffix) * (suffix != "" and name.endswith(suffix))
        self.classes = np.full(0x110000, _UNKNOWN, dtype=np.uint8)
        self.byte_classes = np.zeros(256, dtype=np.uint8)
        if self.kind:
            self.byte_classes[:128] = self._known_classes(np.arange(128))
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[0x41:0x5B] += 0x20
        self._forget()

    # ---------------------------------------------------------------- classes of characters

    def _class(self, char: str) -> int:
        if char == "'":
            return _JOINED
        if self.words:
            normal = self.tokenizer.normalizer.normalize_str(char)
            jamo = 0x1160 <= ord(char) <= 0x11FF or 0xD7B0 <= ord(char) <= 0xD7FF
            if len(normal) != 1 or jamo or unicodedata.combining(char) or unicodedata.category(char) in ("Mn", "Mc", "Me", "Cn", "Cs"):
                return _JOINED
            if normal == " ":
                return _WHITE
            char = normal
        pieces = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(s))
        if pieces("a" + char) == 1:
            return _LETTER
        if pieces("!" + char) == 1:
            return _OTHER
        return _NUMBER if self.words or pieces("1" + char) == 1 else _WHITE

    def _classes(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte's character."""
        cls = self.byte_classes[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            first = data[lead].astype(np.int64)
            width = 2 + (first >= 0xE0) + (first >= 0xF0)
            code = first & np.array([0, 0, 0x1F, 0x0F, 0x07])[width]
            for k in (1, 2, 3):
                more = width > k
                code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
            got = self._known_classes(code)
            cls[lead] = got
            for k in (1, 2, 3):
                more = width > k
                cls[lead[more] + k] = got[more]
        return cls

    def _known_classes(self, code: np.ndarray) -> np.ndarray:
        got = self.classes[code]
        new = got == _UNKNOWN
        if new.any():
            for c in np.unique(code[new]).tolist():
                self.classes[c] = self._class(chr(c))
            got = self.classes[code]
        return got

    # ---------------------------------------------------------------- cuts

    def _pieces(self, data: np.ndarray, edges: np.ndarray, whole: list[tuple[int, int]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All pieces, the index of each edge's first piece, and the pieces that the whole tokenizer must encode (repeats allowed).

        edges: sorted, from 0 to len(data); whole: ranges between edges that are one piece each.
        """
        n = len(data)
        cls = self._classes(data)
        for lo, hi in whole:
            cls[lo:hi] = _JOINED
        white = cls == _WHITE
        edge = np.zeros(n + 1, dtype=bool)
        edge[edges] = True
        begin = edge.copy()
        begin[1:n] |= cls[1:] != cls[:-1]
        if self.words:
            digit = np.flatnonzero(cls == _NUMBER)
            begin[digit[data[digit] & 0xC0 != 0x80]] = True
        else:
            after = np.flatnonzero(begin[1:n] & white[:-1] & ~white[1:]) + 1
            after = after[~edge[after]]
            last = after - 1  # the last white character before a run
            for _ in range(3):
                last = last - (data[last] & 0xC0 == 0x80)
            begin[last] = True
            begin[after[data[last] == 0x20]] = False  # a blank belongs to the run
        joined = np.flatnonzero(cls == _JOINED)
        low = self.lower[data] if self.words else data  # The and the are one piece
        if len(joined):
            change = np.append(white, True)
            run = np.flatnonzero(~change[:-1] & np.append(True, change[:-2] | edge[1:-1])) if n > 1 else np.flatnonzero(~white)
            end = np.flatnonzero(~change[:-1] & (change[1:] | edge[1:]))
            held = np.unique(np.searchsorted(run, joined, side="right") - 1)
            depth = np.zeros(n + 1, dtype=np.int8)
            depth[run[held] + 1] += 1
            depth[end[held] + 1] -= 1
            begin &= np.cumsum(depth, dtype=np.int8) == 0
            for lo, hi in zip(run[held].tolist(), (end[held] + 1).tolist()) if self.words else ():
                low[lo:hi] = data[lo:hi]
        starts = np.flatnonzero(begin[:n])
        if self.words:
            starts = starts[~white[starts]]
            kept_bytes = np.flatnonzero(~white)
            data = low.take(kept_bytes)
            offsets = np.flatnonzero(begin.take(kept_bytes))
        else:
            offsets = starts
        pieces = pa.Array.from_buffers(pa.binary(), len(offsets), [None, pa.py_buffer(np.append(offsets, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        return pieces, np.searchsorted(starts, edges), np.searchsorted(starts, joined, side="right") - 1

    def _windows(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Parts of a long text that end before a blank between two ASCII letters."""
        size, lo = self.slice_bytes, 0
        letter = np.zeros(256, dtype=bool)
        letter[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
        while len(data) - lo > size:
            hi, ahead = lo + size, size
            while hi < len(data):
                part = data[hi - 1 : hi + ahead]
                here = np.flatnonzero((part[1:-1] == 0x20) & letter[part[:-2]] & letter[part[2:]])
                if len(here):
                    hi += int(here[0])
                    break
                hi += max(1, len(part) - 2)
            hi = min(hi, len(data))
            yield lo, hi
            lo = hi
        if lo < len(data):
            yield lo, len(data)

    # ---------------------------------------------------------------- ids

    def _forget(self) -> None:
        self.known = Places(self.keep)
        self.flat = np.zeros(0, dtype=self.width)
        self.at, self.size = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts by the whole tokenizer, and how many each has."""
        got = [np.array(e.ids, dtype=self.width) for lo in range(0, len(texts), 1_000) for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 1_000], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, dtype=self.width), *got]), np.array([len(x) for x in got], dtype=np.int32)

    def _modelled(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces of one class, by the library's model."""
        ids, sizes = [np.zeros(0, dtype=self.width)], [np.zeros(0, dtype=np.int32)]
        for lo in range(0, len(pieces), 1_000):
            some = pieces.slice(lo, 1_000)
            _, where, data = some.buffers()
            offsets = np.frombuffer(where, dtype=np.int32)[some.offset : some.offset + len(some) + 1]
            data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
            ends = offsets[1:] - offsets[0]
            if self.words:
                line = np.insert(data, ends, 0x20)
                if (data >= 0x80).any():  # the rest is lower case already
                    line = np.frombuffer(self.tokenizer.normalizer.normalize_str(line.tobytes().decode()).encode(), dtype=np.uint8)
                ends = np.flatnonzero(line == 0x20)
                units = self.letters[line]
                units[ends] = 0x0A
                ends = ends - np.arange(len(ends))
            else:
                units = np.insert(self.letters[data], ends, 0x0A)
            got = np.array(self.model.encode_batch_fast([units.tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, dtype=self.width)
            reached = np.cumsum(self.letters_of[got])
            last = np.searchsorted(reached, ends)
            if len(ends) != len(some) or not len(reached) or reached[-1] != ends[-1] or (reached[last] != ends).any():
                got, n = self._whole([x.decode() for x in some.to_pylist()])
            else:
                n = np.diff(last, prepend=-1).astype(np.int32)
            ids.append(got)
            sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, pieces: pa.Array, hashes: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """Adds pieces that aren't known and returns their places; joined: those for the whole tokenizer."""
        data, offsets = _parts(pieces)
        kind = np.where(joined, 2, 0)
        kind[np.searchsorted(offsets, np.flatnonzero(data >= 0x80), side="right") - 1] |= 1
        plain = np.concatenate([np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)])  # ASCII ones apart: they need no normalisation
        order = np.concatenate([plain, np.flatnonzero(joined)])
        single, single_n = self._modelled(pieces.take(pa.array(plain)))
        other, other_n = self._whole([x.decode() for x in pieces.take(pa.array(np.flatnonzero(joined))).to_pylist()])
        size = np.concatenate([single_n, other_n])
        at = np.cumsum(size, dtype=np.int64) - size + len(self.flat)
        self.flat = np.concatenate([self.flat, single, other])
        self.at, self.size = np.append(self.at, at.astype(np.int32)), np.append(self.size, size)
        place = np.empty(len(order), dtype=np.int32)
        place[order] = self.known.add(hashes[order], *_parts(pieces.take(pa.array(order))))
        return place

    def _ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one text after another, and where each text's begin (one more than texts)."""
        if not len(data):
            return np.zeros(0, dtype=self.width), np.zeros(len(offsets), dtype=np.int64)
        raw = data.tobytes()
        if not raw.isascii():
            try:
                raw.decode()
            except UnicodeDecodeError:
                fixed = [raw[a:z].decode(errors="replace").encode() for a, z in zip(offsets.tolist(), offsets[1:].tolist())]
                return self._ids(np.frombuffer(b"".join(fixed), dtype=np.uint8), np.cumsum([0, *map(len, fixed)]))
        if self.kind is None:
            ids, n = self._whole([raw[a:z].decode() for a, z in zip(offsets.tolist(), offsets[1:].tolist())])
            return ids, np.append(0, np.cumsum(n))
        whole = self._added(raw, offsets)
        edges = np.unique(np.concatenate([offsets, np.array(whole, dtype=np.int64).reshape(-1)]))
        pieces, first, joined = self._pieces(data, edges, whole)
        first = first[np.searchsorted(edges, offsets)]
        coded = pieces.dictionary_encode()
        distinct, index = coded.dictionary, coded.indices.to_numpy()
        by_whole = np.zeros(len(distinct), dtype=bool)
        by_whole[index[joined]] = True
        raw_pieces = _parts(distinct)
        hashes = Places.hashes(*raw_pieces)
        if len(self.known) + len(distinct) > self.keep or len(self.known.data) > KEEP_BYTES:
            self._forget()
            self.known = Places(max(self.keep, len(distinct)))
        place = self.known.find(hashes, *raw_pieces)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = self._learn(distinct.take(pa.array(new)), hashes[new], by_whole[new])
        at, size = self.at[place], self.size[place]
        n = size[index]
        begins = np.append(0, np.cumsum(n, dtype=np.int64))[first]
        ids = _gather(self.flat, at[index], n)
        return ids, begins

    def _added(self, raw: bytes, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Places of added tokens' strings inside single texts, leftmost first and the longest of those."""
        found = []
        for name in self.added:
            at = raw.find(name)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(name) <= offsets[text + 1]:
                    found.append((at, -len(name)))
                at = raw.find(name, at + 1)
        out, end = [], 0
        for at, size in sorted(found):
            if at >= end:
                end = at - size
                out.append((at, end))
        return out

    def encoded(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Slices of a text column: first row, the ids of its texts, where each text's begin (one more than texts)."""
        for at, data, offsets in chunks(column, self.slice_bytes):
            if len(offsets) == 2 and len(data) > 2 * self.slice_bytes and self.kind:
                held = [0]
                for lo, hi in self._added(data.tobytes(), offsets):
                    held += [lo, hi]
                held.append(len(data))
                parts = []
                for lo, hi in zip(held, held[1:]):  # an added token's string is a part of its own
                    parts += [self._ids(data[lo + a : lo + z], np.array([0, z - a]))[0] for a, z in self._windows(data[lo:hi])]
                ids = np.concatenate(parts)
                yield at, ids, np.array([0, len(ids)])
            else:
                yield at, *self._ids(data, offsets)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [ids[a:z] for _, ids, begins in self.encoded(pa.array(texts, type=pa.string())) for a, z in zip(begins.tolist(), begins[1:].tolist())]


def encoder(path: str, keep: int = KEEP, slice_bytes: int = SLICE) -> Encoder:
    """One encoder per worker, file and bounds."""
    held, own = kept("tokens"), (path, keep, slice_bytes)
    if own not in held:
        held.clear()
        held[own] = Encoder(path, keep, slice_bytes)
    return held[own]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
