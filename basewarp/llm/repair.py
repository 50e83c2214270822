"""Token ids in a file format of Re-Pair grammars, one per shard of documents in doc_id order.

A shard is a run of documents by doc_id.  Its ids, each document closed by an end symbol of
its own that no rule may have on the left, are compressed in rounds: all pairs are counted
by sorting, the frequent ones (``1 / drop`` of the most frequent pair's count or more) become
nonterminals, and their occurrences are replaced from left to right, until no pair occurs
``least`` = 2 times.  A record keeps the rules, every nonterminal's expansion length, the
symbols (each in as many bytes as the largest needs), and per document where its symbols and ids
begin, so any document or range of ids is decoded alone.

Records are rows of a Parquet table in the shared folder, written by Spark's writer: a
lost task is run again, and only committed shards are read.

Defined results: null text is empty and has the end id alone; rows without doc_id come
first, equal doc_ids are ordered by a hash of their texts and then by these; an empty table gives an empty file;
columns besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_of, id_and_text, slots_for, task, written
from .tokens import encoder, tokenizer_path

END_ID = 1
#: Pairs rarer than this get no rule.
LEAST = 2
#: Pairs as frequent as the most frequent one divided by this are replaced in one round.
DROP = 256
#: Pieces that a worker keeps here, and bytes of text that it cuts at once: little else needs memory beside them.
KEEP, SLICE = 1_200_000, 8 << 20
#: A record is full at so many documents or ids.
SHARD_DOCS, SHARD_IDS = 2_000, 8_000_000
_U = np.uint64
_SLOTS = 18

RECORD = "shard long, n_docs long, n_ids long, n_terminals int, doc_ids binary, doc_null binary, doc_symbols binary, doc_starts binary, rules binary, lengths binary, symbols binary, n_symbols long, n_rules long"


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes (1 to 8, the least first) as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        width = len(raw) // n
        out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(n, width)
    return out.reshape(-1).view("<i8")


def _every_other(place: np.ndarray) -> np.ndarray:
    """Of sorted places, in each run of neighbours every other one from its start."""
    count = np.arange(len(place))
    run = np.maximum.accumulate(np.where(np.diff(place, prepend=-2) != 1, count, 0))
    return (count - run) % 2 == 0


def _slot(pairs: np.ndarray) -> np.ndarray:
    if pairs.dtype == np.uint32:
        return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOTS)
    return (pairs * _U(0x9E3779B97F4A7C15)) >> _U(64 - _SLOTS)


def compress(symbols: np.ndarray, first_rule: int, end: int, least: int = LEAST, drop: int = DROP) -> tuple[np.ndarray, np.ndarray]:
    """(rules as rows of left and right, symbols).  Nonterminals count from first_rule; end never stands left in a rule.

    drop: 1 is one count at a time as published; more replaces pairs down to that share of the top count in one round.
    Inside, the terminals that occur are numbered anew without holes, so a symbol has 16 bits, and 32 once these are full.
    """
    there = np.bincount(symbols, minlength=first_rule) > 0
    terminal = np.flatnonzero(there)
    base = len(terminal)
    number = np.cumsum(there) - 1
    rules: list[np.ndarray] = []
    n_rules = 0
    closing = terminal == end  # symbols whose expansion ends a document never stand left
    wide = base >= 1 << 16
    seq = number.astype(np.uint32 if wide else np.uint16)[symbols]
    live = ~closing[seq]  # places at which a pair that may occur again begins
    live[-1:] = False
    table = np.empty(1 << _SLOTS, dtype=np.int32)
    while True:
        place = np.flatnonzero(live)
        left, right = seq.take(place), seq.take(place + 1)
        same = np.flatnonzero(left == right)
        if len(same):  # aaa is one pair, not two
            fine = np.ones(len(place), dtype=bool)
            fine[same[~_every_other(place[same])]] = False
            place, left, right = place[fine], left[fine], right[fine]
        pair = left.astype(_U if wide else np.uint32)
        pair <<= pair.dtype.type(32 if wide else 16)
        pair |= right
        ordered = np.sort(pair)
        if not len(ordered):
            break
        last = np.append(np.flatnonzero(ordered[1:] != ordered[:-1]), len(ordered) - 1)
        n = np.diff(last, prepend=-1)
        best = int(n.max())
        if best < least:
            break
        many = np.flatnonzero(n >= least)
        often = many[n[many] >= best // drop]
        often = often[np.argsort(-n[often], kind="stable")]
        chosen = ordered[last[often]]
        # Per slot of a hashed table: one pair's number; -2 if another pair there occurs again, -1 if none does.
        # A pair that finds its slot taken waits for the next round.
        wanted = _slot(chosen)
        table.fill(-1)
        table[_slot(ordered[last[many]])] = -2
        table[wanted[::-1]] = np.arange(len(chosen), dtype=np.int32)[::-1]
        chosen = chosen[table[wanted] == np.arange(len(chosen))]
        table[_slot(chosen)] = np.arange(len(chosen), dtype=np.int32)
        at = table.take(_slot(pair))
        live[place] = at != -1  # the others occur once from now on
        hit = np.flatnonzero(at >= 0)
        at = at.take(hit)
        mine = np.flatnonzero(chosen.take(at) == pair.take(hit))
        place, at = place.take(hit.take(mine)), at.take(mine)
        # Of overlapping pairs the more frequent one is replaced; the other waits.
        touch = np.diff(place) == 1
        take = np.ones(len(place), dtype=bool)
        take[1:] &= ~touch | (at[1:] < at[:-1])
        take[:-1] &= ~touch | (at[:-1] < at[1:])
        take = np.flatnonzero(take)
        place, at = place.take(take), at.take(take)
        good = np.bincount(at, minlength=len(chosen)) >= least  # always so for the most frequent one
        if not good.all():
            mine = good[at]
            place, at, chosen = place[mine], (np.cumsum(good) - 1)[at[mine]], chosen[good]
        half = chosen.dtype.type(32 if wide else 16)
        own = np.stack([chosen >> half, chosen & chosen.dtype.type((1 << int(half)) - 1)], axis=1).astype(np.int64)
        if not wide and base + n_rules + len(chosen) > 1 << 16:
            wide, seq = True, seq.astype(np.uint32)
        seq[place] = base + n_rules + at
        closing = np.append(closing, closing[own[:, 1]])
        keep = np.ones(len(seq), dtype=bool)
        keep[place + 1] = False
        now = place - np.arange(len(place))
        keep = np.flatnonzero(keep)
        seq, live = seq.take(keep), live.take(keep)
        for near in (now, np.maximum(now - 1, 0)):
            live[near] = ~closing.take(seq.take(near))
        live[-1:] = False
        rules.append(own)
        n_rules += len(own)
    renumbered = np.concatenate([terminal, np.arange(first_rule, first_rule + n_rules)])
    return renumbered[np.concatenate(rules)] if rules else np.zeros((0, 2), dtype=np.int64), renumbered[seq]


def _rounds(rules: np.ndarray, first_rule: int):
    """Runs of rules that only use rules before the run."""
    newest, lo = rules.max(axis=1) - first_rule if len(rules) else np.zeros(0, dtype=np.int64), 0
    while lo < len(rules):
        later = newest[lo:] >= lo
        hi = lo + int(later.argmax()) if later.any() else len(rules)
        yield lo, hi
        lo = hi


def rule_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Expansion length of each nonterminal; rules only use earlier ones."""
    size = np.ones(first_rule + len(rules), dtype=np.int64)
    for lo, hi in _rounds(rules, first_rule):
        size[first_rule + lo : first_rule + hi] = size.take(rules[lo:hi, 0]) + size.take(rules[lo:hi, 1])
    return size[first_rule:]


def _gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces of flat that begin at ``at``, one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Record:
    """One shard: random access to its documents and ids."""

    def __init__(self, row):
        self.first_rule = int(row["n_terminals"])
        self.end = self.first_rule - 1
        self.rules = _unpacked(row["rules"], 2 * row["n_rules"]).reshape(-1, 2)
        self.lengths = _unpacked(row["lengths"], row["n_rules"])
        self.symbols = _unpacked(row["symbols"], row["n_symbols"])
        self.doc_ids = np.frombuffer(row["doc_ids"], dtype="<i8")
        self.doc_null = np.frombuffer(row["doc_null"], dtype="u1").astype(bool)
        self.doc_symbols = np.frombuffer(row["doc_symbols"], dtype="<u8").astype(np.int64)
        self.doc_starts = np.frombuffer(row["doc_starts"], dtype="<u8").astype(np.int64)
        # All expansions, one after another.
        size = np.concatenate([np.ones(self.first_rule, dtype=np.int64), self.lengths])
        self._size, self._at = size, np.cumsum(size) - size
        flat = np.empty(int(size.sum()), dtype=np.uint32)
        flat[: self.first_rule] = np.arange(self.first_rule)
        for lo, hi in _rounds(self.rules, self.first_rule):
            parts = self.rules[lo:hi].reshape(-1)
            grown = _gather(flat, self._at[parts], size[parts])
            begin = self._at[self.first_rule + lo]
            flat[begin : begin + len(grown)] = grown
        self._flat = flat

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        out = _gather(self._flat, self._at[symbols], self._size[symbols])
        return np.where(out == self.end, END_ID, out).astype("<u4")

    def document(self, k: int) -> np.ndarray:
        """The ids of the shard's k-th document, its end id included."""
        return self._expand(self.symbols[self.doc_symbols[k] : self.doc_symbols[k + 1]].astype(np.int64))

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of the shard: only the documents and symbols that hold them are expanded."""
        first = int(np.searchsorted(self.doc_starts, lo, side="right")) - 1
        last = int(np.searchsorted(self.doc_starts, hi, side="left"))
        symbols = self.symbols[self.doc_symbols[first] : self.doc_symbols[last]].astype(np.int64)
        ends = np.cumsum(self._size[symbols]) + self.doc_starts[first]
        a, z = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(ends, hi, side="left")) + 1
        got_from = int(ends[a - 1]) if a else int(self.doc_starts[first])
        return self._expand(symbols[a:z])[lo - got_from : hi - got_from]

    def all_ids(self) -> np.ndarray:
        return self._expand(self.symbols.astype(np.int64))


def record(shard: int, doc_ids: list, ids: list[np.ndarray], vocabulary: int) -> dict:
    """One row of the file: documents in order, without their end ids."""
    end, first_rule = vocabulary, vocabulary + 1
    lens = np.array([len(x) + 1 for x in ids], dtype=np.int64)
    ends, close = np.cumsum(lens), np.array([end], dtype=np.uint32)
    seq = np.concatenate([close[:0], *(x for own in ids for x in (own, close))], dtype=np.uint32, casting="unsafe")
    rules, symbols = compress(seq, first_rule, end)
    lengths = rule_lengths(rules, first_rule)
    size = np.concatenate([np.ones(first_rule, dtype=np.int64), lengths])
    starts = np.concatenate([[0], ends])
    # No rule reaches over an end, so every document begins with a symbol of its own.
    doc_symbols = np.concatenate([[0], np.searchsorted(np.cumsum(size.take(symbols)), ends) + 1])
    return {
        "shard": shard,
        "n_docs": len(ids),
        "n_ids": int(lens.sum()),
        "n_terminals": first_rule,
        "doc_ids": np.array([-1 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        "doc_null": np.array([d is None for d in doc_ids], dtype="u1").tobytes(),
        "doc_symbols": doc_symbols.astype("<u8").tobytes(),
        "doc_starts": starts.astype("<u8").tobytes(),
        "rules": _packed(rules.reshape(-1)),
        "lengths": _packed(lengths),
        "symbols": _packed(symbols),
        "n_symbols": len(symbols),
        "n_rules": len(rules),
    }


_RECORD = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_terminals", pa.int32()), *((c, pa.binary()) for c in ("doc_ids", "doc_null", "doc_symbols", "doc_starts", "rules", "lengths", "symbols")), ("n_symbols", pa.int64()), ("n_rules", pa.int64())])


def write_file(docs: DataFrame, tokenizer: str | None = None, shard_docs: int = SHARD_DOCS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The file's table: one record per shard, shards in doc_id order.

    Spark deals documents to ranges of doc_id and sorts each; a task then streams its range and closes a
    record whenever a shard is full, so it never holds more than one.
    """
    tokenizer = tokenizer or tokenizer_path("word_bpe_49k.json")
    ranges = slots_for(docs.select("doc_id").count(), 4 * shard_docs)

    def build(batches):
        enc, part, number = encoder(tokenizer, KEEP, SLICE), TaskContext.get().partitionId(), 0
        ids: list = []
        found: list[np.ndarray] = []
        size = 0

        def close():
            row = record((part << 32) + number, ids, found, enc.tokenizer.get_vocab_size())
            return batch_of(_RECORD, **{k: [v] for k, v in row.items()})

        for b in batches:
            names = b.column("doc_id").to_pylist()
            for at, got, begins in enc.encoded(b.column("text")):
                edges = begins.tolist()
                for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    ids.append(names[at + k])
                    found.append(got[lo:hi])
                    size += hi - lo + 1
                    if len(ids) >= shard_docs or size >= shard_ids:
                        yield close()
                        ids, found, size, number = [], [], 0, number + 1
        if ids:
            yield close()

    ordered = id_and_text(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange(ranges, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return written(ordered.mapInArrow(task("tokens", build), RECORD), "token-ids")


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_file(file: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the records alone."""
    # Sums of many shards, then of these: neither window has one task for all shards.
    many = F.shiftright(F.shiftright("shard", 32), 11).alias("many")
    sums = file.groupBy(many).agg(F.sum("n_ids").alias("n")).withColumn("before_many", F.coalesce(F.sum("n").over(Window.orderBy("many").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = Window.partitionBy("many").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = file.select("shard", "n_ids", many).withColumn("inside", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    base = base.join(sums.drop("n"), "many").select("shard", (F.col("before_many") + F.col("inside")).cast("long").alias("base"))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                rec = Record(row)
                ids, starts = rec.all_ids(), rec.doc_starts
                crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(starts, starts[1:])]
                yield batch_of(_READ, doc_id=pa.array(rec.doc_ids, mask=rec.doc_null), start=starts[:-1] + row["base"], n_tokens=np.diff(starts), ids_crc32=crc)

    # 16 bytes a shard: sent to every task up to a million shards, joined beyond.
    base = F.broadcast(base) if file.select("shard").count() <= 1_000_000 else base
    return file.join(base, "shard").mapInArrow(task("token-reader", run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame) -> DataFrame:
    return read_file(write_file(docs))
