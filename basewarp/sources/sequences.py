"""Readers of sequence files: one row per record, whatever the format.

Spark reads whole files or records split by the format's own separator; the format is told by
its first lines.  Columns: name, descr, format, seq (letters normalised), seq_len, topology (1 linear,
0 circular).
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import normalise

#: Records of an IG file that leave a task together.
RECORDS = 256
COLUMNS = "name string, descr string, format string, raw string, topology int"


def _clean(lines: list[str]) -> str:
    return "".join("".join(re.split(r"[\s\d]+", x)) for x in lines)


def _numbered(lines: list[str]) -> str:
    """Sequence lines with a leading number."""
    return "".join(re.sub(r"\s", "", re.sub(r"^\s*\d+\s", "", x)) for x in lines)


def detect(text: str) -> str:
    """The format of a file by its text."""
    head = text.lstrip()
    if head.startswith("LOCUS"):
        return "genbank"
    if head.startswith("ID   ") and "\nSQ" in text:
        return "embl"
    if head.startswith("#NEXUS"):
        return "paup"
    if head.startswith("\\\\\\") or re.match(r"ENTRY\s", head):
        return "pir"
    if re.match(r">(P1|DL|DC|F1|N1|N3|RL|RC|XX);", head):
        return "nbrf"
    if head.startswith(">"):
        return "fasta"
    if "DNA Strider" in text[:200]:
        return "strider"
    if head.startswith(";"):
        return "ig"
    if re.search(r"MSF:\s*\d+.*\.\.", text):
        return "msf"
    if re.search(r"\.\.\s*$", text[:4000], flags=re.M):
        return "gcg"
    if re.match(r"[^\n]+\n(\s\S{3})+", text):
        return "fitch"
    return "raw"


def _interleaved(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    out: dict[str, list[str]] = {}
    for name, part in rows:
        out.setdefault(name, []).append(part)
    return [(n, re.sub(r"[\s\d]", "", "".join(p))) for n, p in out.items()]


def _ig(text: str) -> Iterator[tuple[str, str, str]]:
    """(name, description, raw letters) of one record after another: the lines are never all held."""
    comment: list[str] = []
    lines = (m[0] for m in re.finditer(r"[^\n]+", text))
    for line in lines:
        if line.startswith(";"):
            comment.append(line[1:].strip())
        elif line.strip():
            name, body = line.strip(), []
            for more in lines:
                body.append(re.sub(r"\s", "", more))
                if re.search(r"[12]\s*$", more):
                    break
            yield name, " ".join(comment), "".join(body)[:-1] if body else ""
            comment = []


def records(text: str, kind: str | None = None) -> list[tuple[str, str, str, str]]:
    """(name, description, format, raw letters) of every record in a file's text."""
    return [x[:4] for x in typed_records(text, kind)]


def typed_records(text: str, kind: str | None = None) -> list[tuple[str, str, str, str, int | None]]:
    """The same with the topology that the record itself states (0 circular, 1 linear), None where its format says nothing."""
    kind = kind or detect(text)
    text = text.replace("\r\n", "\n")
    out: list[tuple[str, str, str]] = []
    stated: list[int | None] = []
    if kind == "raw":
        out = [("", "", text)]
    elif kind == "fasta":
        for part in re.split(r"^>", text, flags=re.M)[1:]:
            head, _, body = part.partition("\n")
            name, _, descr = head.partition(" ")
            out.append((name.rstrip(","), descr, _clean(body.split("\n"))))
    elif kind == "nbrf":
        for part in re.split(r"^>\w\w;", text, flags=re.M)[1:]:
            name, title, body = (part.split("\n", 2) + ["", ""])[:3]
            out.append((name.strip(), title.strip(), re.sub(r"\s", "", body).rstrip("*")))
    elif kind in ("genbank", "embl"):
        start, tag, title = ("ORIGIN", "LOCUS", "DEFINITION") if kind == "genbank" else ("SQ", "ID", "DE")
        for part in re.split(r"^//[ \t]*$", text, flags=re.M):
            lines = part.strip("\n").split("\n")
            at = next((i for i, x in enumerate(lines) if x.startswith(start)), None)
            if at is None:
                continue
            name = next((x[len(tag) :].split()[0] for x in lines if x.startswith(tag) and x[len(tag) :].split()), "")
            descr = next((x[len(title) :].strip() for x in lines if x.startswith(title)), "")
            first = next((x for x in lines if x.startswith(tag)), "")
            stated.append(0 if re.search(r"\bcircular\b", first, flags=re.I) else 1)
            body = [re.sub(r"\s\d+\s*$", "", x) for x in lines[at + 1 :]] if kind == "embl" else lines[at + 1 :]
            out.append((name.rstrip(","), descr, _numbered(body)))
    elif kind == "gcg":
        head, _, body = re.split(r"(\.\.)[ \t]*\n", text, maxsplit=1)
        name = head.strip().split("\n")[-1].split()
        out.append((name[0] if name else "", head.strip().split("\n")[0].strip(), _numbered(body.split("\n"))))
    elif kind == "msf":
        head, _, body = re.split(r"^(//)[ \t]*$", text, maxsplit=1, flags=re.M)
        names = re.findall(r"Name:\s*(\S+)", head)
        rows = [x.split(None, 1) for x in body.split("\n") if x.split() and x.split()[0] in names]
        out = [(n.rstrip(","), "", s) for n, s in _interleaved([(r[0], r[1]) for r in rows if len(r) > 1])]
    elif kind == "paup":
        body = re.search(r"matrix(.*?);", re.sub(r"\[[^\]]*\]", "", text), flags=re.S | re.I)
        rows = [x.split(None, 1) for x in (body[1] if body else "").split("\n") if len(x.split()) > 1]
        out = [(n.strip(",'"), "", s) for n, s in _interleaved([(r[0], r[1]) for r in rows])]
    elif kind == "ig":
        out = list(_ig(text))
    elif kind == "pir":
        for part in re.split(r"^///[ \t]*$", text, flags=re.M):
            m = re.search(r"^ENTRY\s+(\S+)", part, flags=re.M)
            if not m or "SEQUENCE" not in part:
                continue
            title = re.search(r"^TITLE\s+(.*)", part, flags=re.M)
            body = part.split("SEQUENCE", 1)[1].split("\n")[1:]
            out.append((m[1].rstrip(","), title[1].strip() if title else "", _numbered([x for x in body if not re.fullmatch(r"[\s\d]*", x)])))
    elif kind == "fitch":
        title, _, body = text.partition("\n")
        out.append((title.split(",")[0].strip(), title.strip(), re.sub(r"\s", "", body)))
    elif kind == "strider":
        lines = text.split("\n")
        comments = [x[1:].strip() for x in lines if x.startswith(";")]
        name = next((re.sub(r"^DNA sequence\s+", "", x).split(",")[0] for x in comments if x.startswith("DNA sequence")), "")
        out.append((name, " ".join(comments), "".join(x.strip() for x in lines if not x.startswith(";") and x.strip() != "//")))
    else:
        raise ValueError(f"unknown format {kind!r}")
    return [(n, d, kind, s, t) for (n, d, s), t in zip(out, stated or [None] * len(out))]


#: What Spark's line reader may part records at.
SEPARATORS = {"genbank": "\n//\n", "embl": "\n//\n", "pir": "\n///\n", "nbrf": "\n>"}


def with_sequences(raw: DataFrame, degenerate: bool = True, topology: int | None = None) -> DataFrame:
    """name, descr, format, raw to the columns of a sequence table.

    topology: for all sequences; None: what each record states, linear where it states nothing.
    """
    seq: Column = normalise("raw", degenerate)
    stated = F.coalesce("topology", F.lit(1)) if topology is None and "topology" in raw.columns else F.lit(1 if topology is None else topology)
    out = raw.withColumn("seq", seq)
    return out.select(F.xxhash64("name", "descr", "seq").alias("seq_id"), "name", "descr", "format", "seq", F.length("seq").cast("long").alias("seq_len"), stated.cast("tinyint").alias("topology"))


def read_sequences(spark: SparkSession, path: str, kind: str | None = None, degenerate: bool = True, topology: int | None = None) -> DataFrame:
    """All records of files in any of the formats, told by their text unless named.

    Multi-record files of the formats in SEPARATORS, if the format is named, are split by Spark's own line reader, so
    one huge file is read in parallel; the others, and files whose format is to be told, go file by file.
    """
    if kind == "fasta":
        return with_sequences(_fasta(spark, path), degenerate, topology)
    if kind == "raw":
        raw = spark.read.text(path, wholetext=True).select(F.lit("").alias("name"), F.lit("").alias("descr"), F.lit("raw").alias("format"), F.col("value").alias("raw"))
        return with_sequences(raw, degenerate, topology)

    def run(frames):
        import pandas as pd

        if kind == "ig":  # a file may have any number of records
            for f in frames:
                for text in f["value"]:
                    rows = ((n, d, kind, s, None) for n, d, s in _ig(text.replace("\r\n", "\n") if "\r" in text else text))
                    while some := list(itertools.islice(rows, RECORDS)):
                        yield pd.DataFrame(some, columns=["name", "descr", "format", "raw", "topology"]).astype({"topology": "Int32"})
            return
        for f in frames:
            rows = [r for text in f["value"] for r in typed_records(text, kind)]
            yield pd.DataFrame(rows, columns=["name", "descr", "format", "raw", "topology"]).astype({"topology": "Int32"})

    if kind in SEPARATORS:
        parts = spark.read.text(path, lineSep=SEPARATORS[kind]).select("value")
        if kind == "nbrf":  # the separator takes a record's first character
            parts = parts.select(F.when(F.col("value").startswith(">"), F.col("value")).otherwise(F.concat(F.lit(">"), "value")).alias("value"))
    else:
        parts = spark.read.text(path, wholetext=True).select("value")
    return with_sequences(parts.mapInPandas(run, COLUMNS), degenerate, topology)


def _fasta(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("value"))
    head = F.split_part("value", F.lit("\n"), F.lit(1))
    body = F.regexp_replace(F.expr("substring(value, length(split_part(value, '\n', 1)) + 2)"), r"[\s\d]", "")
    return parts.where("trim(value) <> ''").select(F.rtrim(F.regexp_replace(F.split_part(head, F.lit(" "), F.lit(1)), ",$", "")).alias("name"), F.trim(F.regexp_replace(head, r"^\S*\s?", "")).alias("descr"), F.lit("fasta").alias("format"), body.alias("raw"))


def from_text(docs: DataFrame, degenerate: bool = False, begin: int = 1, end: int = 0) -> DataFrame:
    """Any table with doc_id and text as sequences (the raw reader's rule).

    The one-element explode keeps later filters above the normalising, which then runs once a text.
    """
    from ..functions.sequence import subsequence

    text = F.col("text") if begin <= 1 and not end else subsequence("text", begin, end)
    return docs.select(F.col("doc_id").alias("seq_id"), F.explode(F.array(normalise(text, degenerate))).alias("seq"))
