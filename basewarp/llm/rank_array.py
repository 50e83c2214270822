"""BPE encoding and decoding with a contiguous rank array.

A word is an array of parts (at first its bytes) beside an array of the ranks of adjacent
parts.  Again and again the array is scanned for its smallest rank (the leftmost of equals),
the boundary between the two parts is deleted, what follows moves up by one, and the ranks
left and right of the new part are looked up anew; when no adjacent pair has a rank the word is
done.  Words of like size are the rows of one matrix, so each of these steps is one array
operation for all of them, and a word that is done leaves the matrix.

A scan for each merge costs the square of a word's length.  That suits words; a run of letters
beyond SHORT bytes takes its merges from a heap, in the same order, at n log n.

Where texts are cut and normalised is in tokens.py; each distinct piece is encoded once per worker.
The two kinds of BPE file named there are known, others are an error.  A file without decoder joins tokens by blanks,
as the library does, one with a byte-level decoder joins their bytes.

Defined results: a null or empty text has no ids and decodes to the empty string; rows that
repeat are encoded each; null arrays of ids decode to null, null or unknown ids in an array to nothing; long texts go in
windows; an empty table gives an empty result; columns besides doc_id and text (or ids) are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, id_and_text, kept, task
from .tokens import SLICE, Encoder, _parts, tokenizer_path

#: Bytes of a word that is scanned; longer ones use a heap.
SHORT = 256
#: Ids that are written out at once.
WINDOW = 1 << 20
_NONE = np.iinfo(np.int32).max


class RankArray:
    """The merges of a BPE file: words as bytes to ids."""

    def __init__(self, vocab: dict[str, int], merges: list, letters: np.ndarray, suffix: str):
        letter = [chr(x) for x in letters.tolist()]
        try:
            self.inner = np.array([vocab[x] for x in letter], dtype=np.int64)
            self.last = np.array([vocab[x + suffix] for x in letter], dtype=np.int64)
        except KeyError as e:
            raise ValueError(f"the vocabulary lacks the byte {e}") from e
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        back = np.arange(len(key))[::-1]  # of a pair that is listed twice the later one counts, as in the library
        self.key, first = np.unique(key[back], return_index=True)
        self.rank = back[first].astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.known: dict[int, int] = {}  # the same for single pairs of long words

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of adjacent parts."""
        if not len(self.key):
            return np.full(left.shape, _NONE, dtype=np.int32)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NONE)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word after another, and how many each has.  offsets: one more than words."""
        size = np.diff(offsets).astype(np.int64)
        parts = self.inner[data]
        end = offsets[1:][size > 0] - 1
        parts[end] = self.last[data[end]]
        count, where = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
        found, total = [np.zeros(0, dtype=np.int64)], 0
        width, below = 4, 0
        while below < SHORT:
            some = np.flatnonzero((size > below) & (size <= width))
            for lo in range(0, len(some), (1 << 20) // width):
                words = some[lo : lo + (1 << 20) // width]
                ids, n = self._scanned(parts, offsets[words].astype(np.int64), size[words], width)
                where[words], count[words] = total + np.cumsum(n) - n, n
                found.append(ids)
                total += len(ids)
            below, width = width, 2 * width
        for word in np.flatnonzero(size > below):
            ids = self._heaped(parts[offsets[word] : offsets[word + 1]])
            where[word], count[word] = total, len(ids)
            found.append(ids)
            total += len(ids)
        ends = np.cumsum(count)
        inside = np.arange(total) - np.repeat(ends - count, count)
        return np.concatenate(found)[inside + np.repeat(where, count)], count

    def _scanned(self, parts: np.ndarray, at: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of at most ``width`` bytes, and how many each has."""
        column = np.arange(width)
        inside = column < size[:, None]
        matrix = np.full((len(at), width), -1, dtype=np.int64)
        matrix[inside] = parts[(at[:, None] + column)[inside]]
        rank = np.full((len(at), width), _NONE, dtype=np.int32)  # of the pair that begins here
        rank[:, :-1][inside[:, 1:]] = self.ranks(matrix[:, :-1][inside[:, 1:]], matrix[:, 1:][inside[:, 1:]])
        done = np.full((len(at), width), -1, dtype=np.int64)
        word = np.arange(len(at))
        while len(word):
            row = np.arange(len(word))
            k = rank.argmin(axis=1)
            best = rank[row, k]
            over = best == _NONE
            if over.any():
                done[word[over], : matrix.shape[1]] = matrix[over]
                go = ~over
                word, matrix, rank, k, best = word[go], matrix[go], rank[go], k[go], best[go]
                row = np.arange(len(word))
                if not len(word):
                    break
            # The boundary after part k goes: parts and ranks behind it move up.
            last = matrix.shape[1] - 1
            move = column[:last] + (column[:last] > k[:, None])
            matrix[row, k] = self.made[best]
            matrix = np.take_along_axis(matrix, move, axis=1)
            rank = np.take_along_axis(rank, column[:last] + (column[:last] >= k[:, None]), axis=1)
            for left in (k - 1, k):
                fresh = np.flatnonzero((left >= 0) & (left < last))
                a = left[fresh]
                right = np.where(a + 1 < last, matrix[fresh, np.minimum(a + 1, last - 1)], -1)
                new = np.full(len(fresh), _NONE, dtype=np.int32)
                new[right >= 0] = self.ranks(matrix[fresh, a][right >= 0], right[right >= 0])
                rank[fresh, a] = new
        return done[done >= 0], (done >= 0).sum(axis=1)

    def _heaped(self, parts: np.ndarray) -> np.ndarray:
        """Ids of one long word."""
        n = len(parts)
        ids, after, before = parts.tolist(), [*range(1, n), -1], [-1, *range(n - 1)]
        if not self.known:
            self.known = dict(zip(self.key.tolist(), self.rank.tolist()))
        known, rank = self.known, self.ranks(parts[:-1], parts[1:])
        heap = [(int(rank[i]), int(i)) for i in np.flatnonzero(rank != _NONE)]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or known.get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0:
                    got = known.get(ids[a] << 32 | ids[after[a]])
                    if got is not None:
                        heapq.heappush(heap, (got, a))
        return np.array([x for x in ids if x >= 0], dtype=np.int64)


class Codec(Encoder):
    """Ids of texts by rank arrays, and texts of ids."""

    def __init__(self, path: str, keep: int | None = None, slice_bytes: int = SLICE):
        super().__init__(path, keep, slice_bytes)
        if self.kind is None:
            raise ValueError(f"{path}: not a kind of BPE file that is known here")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = RankArray(spec["model"]["vocab"], spec["model"]["merges"], self.letters, spec["model"].get("end_of_word_suffix") or "")
        self.byte_of = {chr(x): k for k, x in enumerate(self.letters.tolist())}
        self.added_ids = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        names = self.tokenizer.get_vocab()
        decoder = (spec.get("decoder") or {}).get("type")
        if decoder not in (None, "ByteLevel"):
            raise ValueError(f"{path}: the decoder {decoder} is not known here")
        self.apart = decoder is None
        shown = [b""] * (max(names.values()) + 1)
        for name, at in names.items():
            shown[at] = name.encode() + b" " if self.apart else name.encode() if name in self.added_ids else bytes(self.byte_of[x] for x in name)
        self.shown = pa.array(shown, type=pa.binary())
        self.decimal = pa.array([b"%d " % k for k in range(len(shown))], type=pa.binary())

    # What Encoder leaves to the library's model goes to the rank arrays; the library only normalises and cuts.

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, n = [], []
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for text in texts:
            if text in self.added_ids:
                ids.append(np.array([self.added_ids[text]]))
                n.append(1)
                continue
            normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
            words = [bytes(self.byte_of[x] for x in word) for word, _ in cut(normal)]
            got, _ = self.merges.encode(np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum([0, *map(len, words)]))
            ids.append(got)
            n.append(len(got))
        return np.concatenate([np.zeros(0, dtype=np.int64), *ids]).astype(self.width), np.array(n, dtype=np.int32)

    def _modelled(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = _parts(pieces)
        if self.words and (data >= 0x80).any():
            line = self.tokenizer.normalizer.normalize_str(np.insert(data, offsets[1:], 0x20).tobytes().decode()).encode()
            line = np.frombuffer(line, dtype=np.uint8)
            blank = np.flatnonzero(line == 0x20)
            if len(blank) != len(pieces):
                return self._whole([x.decode() for x in pieces.to_pylist()])
            data, offsets = line[line != 0x20], np.append(0, blank - np.arange(len(blank)))
        ids, n = self.merges.encode(data, offsets.astype(np.int64))
        return ids.astype(self.width), n.astype(np.int32)

    def _joined(self, ids: np.ndarray, by: pa.Array):
        """The bytes of ids in windows, as memory views."""
        for lo in range(0, len(ids), WINDOW):
            data, _ = _parts(by.take(pa.array(ids[lo : lo + WINDOW])))
            yield memoryview(data)

    def decoded(self, ids: np.ndarray) -> str:
        """The text of ids that are all known."""
        text = b"".join(self._joined(ids, self.shown))
        return (text[:-1] if self.apart else text).decode(errors="replace")

    def known_ids(self, ids: np.ndarray) -> np.ndarray:
        return ids[(ids >= 0) & (ids < len(self.shown))]

    def digests(self, ids: np.ndarray, begins: np.ndarray) -> tuple[list[str], list[str]]:
        """SHA-256 of each text's ids as decimal numbers with a blank between, and of its decoded text."""
        out = []
        for by, blank in ((self.decimal, True), (self.shown, self.apart)):
            found = []
            if len(ids) <= WINDOW and (self.apart or by is self.decimal):
                data, offsets = _parts(by.take(pa.array(ids)))
                view, at = memoryview(np.ascontiguousarray(data)), offsets[begins].tolist()
                found = [hashlib.sha256(view[a : max(a, z - 1)]).hexdigest() for a, z in zip(at, at[1:])]
            else:
                for a, z in zip(begins.tolist(), begins[1:].tolist()):
                    if by is self.shown and not self.apart:
                        found.append(hashlib.sha256(self.decoded(ids[a:z]).encode()).hexdigest())
                        continue
                    sha, held = hashlib.sha256(), b""
                    for view in self._joined(ids[a:z], by):
                        sha.update(held)
                        sha.update(view[:-1])
                        held = bytes(view[-1:])  # the last blank of all is left out
                    found.append(sha.hexdigest())
            out.append(found)
        return out[0], out[1]


def codec(path: str) -> Codec:
    """One codec per worker and file."""
    held = kept("rank-array")
    if path not in held:
        held.clear()
        held[path] = Codec(path)
    return held[path]


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
WORD_FILE = "word_bpe_49k.json"


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every row."""
    path = path or tokenizer_path(WORD_FILE)

    def run(batches):
        for b in batches:
            for at, ids, begins in codec(path).encoded(b.column("text")):
                lists = pa.LargeListArray.from_arrays(pa.array(begins, type=pa.int64()), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(begins) - 1), lists], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(task("rank-array", run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of every row of doc_id, ids."""
    path = path or tokenizer_path(WORD_FILE)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                texts = [None if not x.is_valid else codec(path).decoded(codec(path).known_ids(x.values.drop_null().to_numpy().astype(np.int64))) for x in some.column("ids")]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(task("rank-array", run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, its ids decoded, and both digested where they are."""
    path = path or tokenizer_path(WORD_FILE)

    def run(batches):
        for b in batches:
            for at, ids, begins in codec(path).encoded(b.column("text")):
                numbers, texts = codec(path).digests(ids, begins)
                yield batch_of(_DIGESTS, doc_id=b.column("doc_id").slice(at, len(begins) - 1), n_tokens=np.diff(begins), ids_sha256=numbers, decoded_sha256=texts)

    return id_and_text(docs).mapInArrow(task("rank-array", run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
