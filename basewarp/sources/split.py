"""Sequence files of any size and format as sequences in parts: no row, task or worker holds a file or a record whole.

Spark's line reader deals byte ranges of the files, from any store that Spark reads.  A format is a small table of line
rules; as a range may begin anywhere, its lines are followed from every state that the format has (those that meet go on as
one), and where each range really begins comes from composing, file by file, one row per range.

Letters come in pieces with the range and the number that order them; ``read_parts`` numbers them for
operators.parts.  Interleaved formats need nothing more: the blocks of a name are further pieces of its sequence.

Empty files and records without letters have no parts.  Records are told apart by file and number (aligned ones by file and
name), so equal records in two files, or twice in one, stay two.  A comment inside a row of a PAUP matrix must end on its line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import normalise
from ..operators.parts import join_parts
from .files import written

#: Letters of a piece, and rows that leave a task together.
PIECE, ROWS = 1 << 15, 256

STAY, BEGIN, END = 0, 1, 2  # whether a line opens a record or is the last of one


def _rules(*rows: tuple[str, int, int]) -> list[tuple[re.Pattern, int, int]]:
    return [(re.compile(p), state, what) for p, state, what in rows]


_BODY = r"(?P<body>.*)"
_SLASHES = r"//[ \t]*$"


def _sections(close: str, name: str, opens: str, *more: str) -> list:
    """Formats with a head (0) and a body (1), both ended by one line."""
    return [_rules((close, 0, END), (name, 0, STAY), *((x, 0, STAY) for x in more), (opens, 1, STAY)), _rules((close, 0, END), (_BODY, 1, STAY))]


_FASTA = (r">(?P<name>[^ ]*?),?(?: (?P<descr>.*))?$", 1, BEGIN)
_NBRF = (r">\w\w;(?P<name>.*)", 1, BEGIN)
_ROW = r"\s*(?P<key>[^\s;]+)\s+(?P<body>[^;]*)"

#: Per format and state the rules of a line, the first that matches counts: pattern, next state, what it does to the record.
#: Groups: name, descr, locus (a line that may state the topology), head (first is the description, last has the name),
#: listed (a name that the head lists), key and body (letters, of the sequence with that name).
FORMATS: dict[str, list[list[tuple[re.Pattern, int, int]]]] = {
    "raw": [_rules((_BODY, 0, STAY))],
    "fasta": [_rules(_FASTA), _rules(_FASTA, (_BODY, 1, STAY))],
    "nbrf": [_rules(_NBRF), _rules(_NBRF, (r"(?P<descr>.*)", 2, STAY)), _rules(_NBRF, (_BODY, 2, STAY))],
    "genbank": _sections(_SLASHES, r"(?P<locus>LOCUS\s+(?P<name>\S+).*)", r"ORIGIN", r"DEFINITION(?P<descr>.*)"),
    "embl": _sections(_SLASHES, r"(?P<locus>ID\s+(?P<name>\S+).*)", r"SQ", r"DE(?P<descr>.*)"),
    "pir": _sections(r"///[ \t]*$", r"ENTRY\s+(?P<name>\S+)", r"SEQUENCE", r"TITLE\s+(?P<descr>.*)"),
    "ig": [_rules((r";(?P<descr>.*)", 0, STAY), (r"(?P<name>.*\S.*)", 1, STAY)), _rules((r"(?P<body>.*)[12]\s*$", 0, END), (_BODY, 1, STAY))],
    "gcg": [_rules((r"(?P<head>.*)\.\.[ \t]*$", 1, STAY), (r"(?P<head>.*\S.*)", 0, STAY)), _rules((_BODY, 1, STAY))],
    "fitch": [_rules((r"(?P<descr>(?P<name>[^,]*).*)", 1, STAY)), _rules((_BODY, 1, STAY))],
    "strider": [_rules((r";(?P<descr>\s*DNA sequence\s+(?P<name>[^,]*).*)", 0, STAY), (r";(?P<descr>.*)", 0, STAY), (_BODY, 0, STAY))],
    "msf": [_rules((_SLASHES, 1, STAY), (r".*?Name:\s*(?P<listed>\S+)", 0, STAY)), _rules((r"\s*(?P<key>\S+)\s+(?P<body>.+)", 1, STAY))],
    "paup": [
        _rules((rf"(?i).*?matrix(?:{_ROW})?;", 2, STAY), (rf"(?i).*?matrix(?:{_ROW})?", 1, STAY)),
        _rules((rf"{_ROW};", 2, STAY), (r"[^;]*;", 2, STAY), (_ROW, 1, STAY)),
        [],
    ],
}
#: Formats with comments in brackets: the second half of their states is the first, inside one.
BRACKETS = {"paup"}
ALIGNED = {"msf", "paup"}


def states(kind: str) -> int:
    return len(FORMATS[kind]) * (2 if kind in BRACKETS else 1)


def uncommented(line: str, inside: bool) -> tuple[str, bool]:
    """The line without what stands in brackets, and whether a bracket is open at its end."""
    out, at = [], 0
    while True:
        to = line.find("]" if inside else "[", at)
        if not inside:
            out.append(line[at:] if to < 0 else line[at:to])
        if to < 0:
            return "".join(out), inside
        at, inside = to + 1, not inside


class _Course:
    """Lines of a range as they read from one state, and the states it may be entered with that have led there."""

    def __init__(self, state: int, entries: dict[int, int]):
        self.state, self.entries, self.records = state, entries, 0
        self.letters: dict[str, list[str]] = {}
        self.size, self.head = 0, []


class _Range:
    """All courses through one byte range, and the rows they give: kind, key, records (by entry state; null: not from it), no, text."""

    def __init__(self, kind: str, file: str, block: int):
        self.kind, self.file, self.block, self.no = kind, file, block, 0
        self.rules, self.n = FORMATS[kind], states(kind)
        #: States whose every line is letters and leads nowhere else.
        self.free = [kind not in BRACKETS and [(p.pattern, what) for p, _, what in self.rules[s % len(self.rules)]] == [(_BODY, STAY)] for s in range(self.n)]
        self.courses = [_Course(s, {s: 0}) for s in (range(self.n) if block else (0,))]
        self.rows: list[tuple] = []

    def row(self, c: _Course, what: str, key: str, text: str) -> None:
        self.rows.append((self.file, self.block, what, key, [c.entries[s] + c.records if s in c.entries else None for s in range(self.n)], self.no, text))
        self.no += 1

    def flush(self, c: _Course) -> None:
        for key, some in c.letters.items():
            text = "".join(some)
            for at in range(0, len(text), PIECE):
                self.row(c, "body", key, text[at : at + PIECE])
        for text in c.head[:1] + c.head[-1:]:
            self.row(c, "head", "", text)
        c.letters, c.size, c.head = {}, 0, []

    def line(self, text: str) -> None:
        for c in self.courses:
            if self.free[c.state]:
                self.add(c, "", text)
                continue
            state, said = c.state, text
            half = len(self.rules)
            if self.kind in BRACKETS:
                said, inside = uncommented(text, state >= half)
                state %= half
            for pattern, to, what in self.rules[state]:
                m = pattern.match(said)
                if not m:
                    continue
                state = to
                if what == BEGIN:
                    self.flush(c)
                    c.records += 1
                self.facts(c, m.groupdict())
                if what == END:
                    self.flush(c)
                    c.records += 1
                break
            c.state = state + half if self.kind in BRACKETS and inside else state
        if len(self.courses) > 1:
            self.meet()

    def add(self, c: _Course, key: str, letters: str) -> None:
        c.letters.setdefault(key, []).append(letters)
        c.size += len(letters)
        if c.size >= PIECE:
            self.flush(c)

    def facts(self, c: _Course, said: dict[str, str | None]) -> None:
        if said.get("body"):
            self.add(c, (said.get("key") or "").strip(",'"), said["body"])
        if (said.get("head") or "").strip():
            c.head = c.head[:1] + [said["head"].strip()]
        if said.get("listed"):
            self.row(c, "listed", said["listed"].rstrip(","), "")
        for field in ("name", "descr", "locus"):
            if said.get(field) is not None and said[field].strip():
                self.row(c, field, "", said[field].strip().rstrip("," if field == "name" else ""))

    def meet(self) -> None:
        """Courses in one state go on as one."""
        by: dict[int, _Course] = {}
        for c in self.courses:
            other = by.setdefault(c.state, c)
            if other is not c:
                for x in (other, c):
                    self.flush(x)
                    x.entries, x.records = {s: n + x.records for s, n in x.entries.items()}, 0
                other.entries |= c.entries
        self.courses = list(by.values())

    def end(self) -> None:
        for c in self.courses:
            self.flush(c)
            self.row(c, "end", "", str(c.state))


_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("what", pa.string()), ("key", pa.string()), ("records", pa.list_(pa.int64())), ("no", pa.int64()), ("text", pa.string())])
_COLUMNS = "file string, block long, what string, key string, records array<long>, no long, text string"


def _walk(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    now: _Range | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        lines = batch.column("value").to_pylist()
        file, block = pc.dictionary_encode(batch.column("file")), batch.column("block").to_numpy()
        code = file.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(lines)]
        for lo, hi in zip(cuts, cuts[1:]):
            name, start = file.dictionary[int(code[lo])].as_py(), int(block[lo])
            if now is None or (now.file, now.block) != (name, start):
                if now is not None:
                    now.end()
                    yield out(now.rows)
                now = _Range(kind, name, start)
            for text in lines[lo:hi]:
                now.line(text)
                if len(now.rows) >= ROWS:
                    yield out(now.rows)
                    now.rows = []
    if now is not None:
        now.end()
        yield out(now.rows)


def _entries(ends: pd.DataFrame) -> pd.DataFrame:
    """For each range of one file the state it is entered with and the records begun before."""
    rows, state, before = [], 0, 0
    for ordinal, (block, some) in enumerate(ends.sort_values("block").groupby("block", sort=True)):
        rows.append((some["file"].iloc[0], block, ordinal, state, before))
        left, more = next((int(t), int(r[state])) for t, r in zip(some["text"], some["records"]) if not pd.isna(r[state]))
        state, before = left, before + more
    return pd.DataFrame(rows, columns=["file", "block", "ordinal", "entry", "before"])


def _resolved(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """file, record, key, what, at (order in the file), text: what the lines say, read from the states that they are reached in."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    walked = written(lines.mapInArrow(lambda bs: _walk(bs, kind), _COLUMNS), "walked")
    ends = walked.where("what = 'end'").select("file", "block", "records", "text")
    entries = ends.groupBy("file").applyInPandas(_entries, "file string, block long, ordinal long, entry int, before long")
    said = walked.where("what <> 'end'").join(entries, ["file", "block"])
    at = F.col("ordinal") * F.lit(1 << 32) + F.col("no")
    record = F.lit(0).cast("long") if kind in ALIGNED else F.col("before") + F.get("records", F.col("entry"))
    return said.where(F.get("records", F.col("entry")).isNotNull()).select("file", record.alias("record"), "key", "what", at.alias("at"), "text")


_ID = ("file", "record", "key")


def _headers(said: DataFrame, kind: str) -> DataFrame:
    def pick(field: str):
        return F.min_by("text", F.when(F.col("what") == field, F.col("at")))

    def last(field: str):
        return F.max_by("text", F.when(F.col("what") == field, F.col("at")))

    comments = F.array_sort(F.collect_list(F.when(F.col("what") == "descr", F.struct("at", "text"))))
    rows = said.groupBy(*_ID).agg(
        pick("name").alias("name"), pick("head").alias("first"), last("head").alias("last"), pick("locus").alias("locus"),
        (F.array_join(F.transform(comments, lambda x: x["text"]), " ") if kind in ("ig", "strider") else pick("descr")).alias("descr"),
        F.max(F.col("what") == "body").alias("has_body"), F.max(F.col("what") == "listed").alias("listed"),
    )
    rows = rows.where("has_body AND listed" if kind == "msf" else "has_body")
    name = F.col("key") if kind in ALIGNED else F.regexp_extract("last", r"^(\S+)", 1) if kind == "gcg" else F.col("name")
    descr = F.col("first") if kind == "gcg" else F.col("descr")
    circular = F.coalesce(F.col("locus").rlike(r"(?i)\bcircular\b"), F.lit(False))
    return rows.select(*_ID, F.xxhash64(*_ID).alias("seq_id"), F.coalesce(name, F.lit("")).alias("name"), F.coalesce(descr, F.lit("")).alias("descr"), F.lit(kind).alias("format"), F.when(circular, 0).otherwise(1).cast("tinyint").alias("topology"))


def read_headers(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """seq_id, name, descr, format, topology of every record that has a body, seq_id as read_parts has it."""
    return _headers(_resolved(spark, path, kind), kind).drop(*_ID)


def read_parts(spark: SparkSession, path: str, kind: str, degenerate: bool = True) -> DataFrame:
    """Parts (seq_id, seq_len, base, bases) of every record of the files, for all searches that work in chunks.

    kind is one of FORMATS.  Each call reads the files once and writes what the lines say; write its result to search it often.
    """
    return _parts(_resolved(spark, path, kind), kind, degenerate)


def read_both(spark: SparkSession, path: str, kind: str, degenerate: bool = True) -> tuple[DataFrame, DataFrame]:
    """read_headers and read_parts of the same files, which are read once for both."""
    said = _resolved(spark, path, kind)
    return _headers(said, kind).drop(*_ID), _parts(said, kind, degenerate)


def _parts(said: DataFrame, kind: str, degenerate: bool) -> DataFrame:
    body = said.where("what = 'body'")
    if kind == "msf":  # rulers and other lines that name no sequence
        body = body.join(said.where("what = 'listed'").select("file", "key").distinct(), ["file", "key"], "left_semi")
    return join_parts(body.select(F.xxhash64(*_ID).alias("seq_id"), F.col("at").alias("part_no"), normalise("text", degenerate).alias("seq")))
