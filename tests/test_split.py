"""Readers by byte ranges against the readers that take a file whole."""

import random
import re

import pandas as pd
import pyarrow as pa
import pytest

from basewarp.operators import derive, match
from basewarp.plans.patterns import DEMO
from basewarp.sources import sequences as src
from basewarp.sources import split

from .test_engine import SINGLE, TEXTS

LETTERS = "acgtrymkbdhvwsn"


def letters(n, seed):
    return "".join(random.Random(seed).choices(LETTERS, k=n))


def lines(text, n=60):
    return "\n".join(text[i : i + n] for i in range(0, len(text), n))


def long_text(kind, n=7, size=900):
    """A file of n records (one for formats of one) of the format."""
    seqs = [(f"r{i}", letters(size + 37 * i, i)) for i in range(n)]
    name, seq = seqs[0]
    half = [(k, s[: len(s) // 2], s[len(s) // 2 :]) for k, s in seqs]
    one, two = ("\n".join(f"{k}  {x}" for k, x in ((r[0], r[j]) for r in half)) for j in (1, 2))
    return {
        "raw": lambda: lines(seq),
        "fasta": lambda: "\n".join(f">{k} title {k}\n{lines(s)}" for k, s in seqs) + "\n",
        "genbank": lambda: "".join(f"LOCUS       {k}  9 bp DNA circular\nDEFINITION  title {k}\nORIGIN\n   1 {lines(s)}\n//\n" for k, s in seqs),
        "embl": lambda: "".join(f"ID   {k}; circular\nDE   title {k}\nSQ   9 BP\n     {lines(s)}   60\n//\n" for k, s in seqs).replace("; circular", " circular"),
        "nbrf": lambda: "".join(f">DL;{k}\ntitle {k}\n{lines(s)}*\n" for k, s in seqs),
        "pir": lambda: "".join(f"ENTRY           {k}\nTITLE           title {k}\nSEQUENCE\n    5   10\n  1 {lines(s)}\n///\n" for k, s in seqs),
        "ig": lambda: "".join(f"; title {k}\n; more\n{k}\n{lines(s)}1\n" for k, s in seqs),
        "gcg": lambda: f"a title\nof two lines\n  {name}  Length: 9  Check: 1  ..\n\n  1 {lines(seq)}\n",
        "fitch": lambda: f"{name}, 9 bases\n {lines(seq)}\n",
        "strider": lambda: f"; ### from DNA Strider ###\n; DNA sequence {name}, 9 bp\n;\n{lines(seq)}\n//\n",
        "msf": lambda: " x  MSF: 9  Type: N  Check: 1 ..\n\n" + "".join(f" Name: {k}   Len: 9\n" for k, _ in seqs) + f"\n//\n\n          1     60\n{one}\n\n{two}\n",
        "paup": lambda: f"#NEXUS\n[a matrix;\n over lines]\nbegin data;\n matrix\n\n{one}\n[between; rows]\n{two}\n;\nend;\nr1 acgt\n",
    }[kind]()


def plain(text):
    return re.sub(f"[^{LETTERS}]", "", text.lower().replace("u", "t"))


def wanted(text, kind):
    return sorted((n, d.strip(), plain(s), 1 if t is None else t) for n, d, _, s, t in src.typed_records(text, kind) if plain(s))


def by_ranges(text, kind, cuts):
    """The same from ranges of lines, without Spark."""
    every, at, rows = text.split("\n"), 0, []
    for no, hi in enumerate([*cuts, len(text.split("\n"))]):
        r = split._Range(kind, "f", no)
        for x in every[at:hi]:
            r.line(x)
        at = hi
        r.end()
        rows += r.rows
    frame = pd.DataFrame(rows, columns=split._SCHEMA.names)
    entries = split._entries(frame[frame["what"] == "end"]).set_index("block")
    out = {}
    for r in frame[frame["what"] != "end"].itertuples():
        e = entries.loc[r.block]
        if r.records[e["entry"]] is not None and r.what == "body":
            record = 0 if kind in split.ALIGNED else e["before"] + r.records[e["entry"]]
            out.setdefault((record, r.key), []).append((r.block, r.no, r.text))
    listed = set(frame[frame["what"] == "listed"]["key"])
    return sorted(s for k, x in out.items() if kind != "msf" or k[1] in listed for s in [plain("".join(t for *_, t in sorted(x)))] if s)


@pytest.mark.parametrize("kind", split.FORMATS)
def test_ranges_may_begin_anywhere(kind, monkeypatch):
    monkeypatch.setattr(split, "PIECE", 100)
    rng = random.Random(3)
    for text in (long_text(kind, 3, 200), *([x] if (x := (TEXTS | SINGLE).get(kind)) else [])):
        want = sorted(x[2] for x in wanted(text, kind))
        n = text.count("\n")
        for cuts in ([i] for i in range(1, n)):
            assert by_ranges(text, kind, cuts) == want, cuts
        for _ in range(20):
            assert by_ranges(text, kind, sorted(rng.choices(range(1, n), k=5))) == want


@pytest.mark.parametrize("kind", split.FORMATS)
@pytest.mark.parametrize("size", [300, 1 << 20])
def test_parts_of_files(spark, tmp_path, kind, size):
    (tmp_path / "a").write_text(long_text(kind))
    (tmp_path / "b").write_text(long_text(kind, 2, 400).replace("\n", "\r\n"))
    (tmp_path / "empty").write_text("")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        assert (spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count() > 1) == (size == 300)
        heads = {r["seq_id"]: r for r in split.read_headers(spark, str(tmp_path), kind).collect()}
        parts = sorted((r["seq_id"], r["base"], r["seq_len"], r["bases"]) for r in split.read_parts(spark, str(tmp_path), kind).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    got = []
    for i, h in heads.items():
        own = [x for x in parts if x[0] == i]
        text = "".join(x[3] for x in own)
        assert {x[2] for x in own} == {len(text)} and [x[1] for x in own] == [sum(len(y[3]) for y in own[:k]) for k in range(len(own))]
        got.append((h["name"], h["descr"], text, h["topology"]))
        assert h["format"] == kind
    assert {x[0] for x in parts} == set(heads)
    want = sorted(wanted(long_text(kind), kind) + wanted(long_text(kind, 2, 400), kind))
    assert sorted(got) == want


def test_search_in_parts_of_files(spark, tmp_path):
    text = letters(30_000, 5)
    (tmp_path / "one.fa").write_text(f">one\n{lines(text)}\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    try:
        got = derive.hit_counts(derive.distinct_sites(match.find_sites(split.read_parts(spark, str(tmp_path), "fasta"), DEMO))).drop("seq_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    whole = spark.createDataFrame([(1, text)], "seq_id long, seq string")
    want = derive.hit_counts(derive.distinct_sites(match.find_sites(whole, DEMO))).drop("seq_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_a_long_line_is_cut_and_an_unknown_format_told(spark, tmp_path):
    text = letters(5 * split.PIECE // 2, 8)
    (tmp_path / "f").write_text(f"> x y\n{text}")
    parts = split.read_parts(spark, str(tmp_path), "fasta").orderBy("base").collect()
    assert "".join(r["bases"] for r in parts) == text and len(parts) == 3
    assert split.read_headers(spark, str(tmp_path), "fasta").first()["name"] == ""
    with pytest.raises(ValueError, match="unknown format"):
        split.read_parts(spark, str(tmp_path), "odd")


def test_batches_of_several_files():
    batch = pa.RecordBatch.from_pydict({"value": [">a", "ac", ">b", "g"], "file": ["x", "x", "y", "y"], "block": pa.array([0, 0, 0, 0], pa.int64())})
    rows = [r for b in split._walk(iter([batch.slice(0, 1), batch.slice(1), batch.slice(0, 0)]), "fasta") for r in b.to_pylist()]
    assert [(r["file"], r["text"], r["records"]) for r in rows if r["what"] == "body"] == [("x", "ac", [1, None]), ("y", "g", [1, None])]
