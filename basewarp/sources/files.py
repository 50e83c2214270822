"""Readers of pattern, regex, matrix, rule and codon files, the search path, and sinks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.patterns import Pattern, pattern
from ..plans.rules import Rule, parse_rules_file


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all machines see (in spark.checkpoint.dir, deleted when the application ends); a temporary one
    only where driver and executors are one process."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="basewarp-")
    path = f"{shared}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in a scratch folder, for what several parts of a plan read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def search(name: str, variable: str = "BASEWARP_DATA") -> str:
    """The first of: the path itself, the working folder, the home folder, the folder named by the variable."""
    for folder in ("", os.getcwd(), os.path.expanduser("~"), os.environ.get(variable, "")):
        path = os.path.join(folder, name) if folder else name
        if os.path.isfile(path):
            return path
    raise FileNotFoundError(name)


def load_text(spark: SparkSession, path: str) -> str:
    """A small text file by Spark's reader, so any file system works."""
    return spark.read.text(path, wholetext=True).first()["value"]


def _body(text: str) -> list[str]:
    """Lines after the one that ends in two dots, without comments and blank lines."""
    lines = text.splitlines()
    at = next((i for i, x in enumerate(lines) if x.strip() == ".."), -1)
    return [x for x in lines[at + 1 :] if x.strip() and not x.lstrip().startswith(";")]


def parse_patterns(text: str) -> list[Pattern]:
    """Lines of: name, top offset, site (' top cut, _ bottom cut), overhang, errors, dam, dcm, units, price, ! comments."""
    out = []
    for line in _body(text):
        f = line.split("!")[0].split()
        numbers = [int(x) if re.fullmatch(r"-?\d+", x) else 0 for x in f[3:]]
        numbers += [0] * (6 - len(numbers))
        overhang, errors, dam, dcm, units, price = numbers[:6]
        if len(f) < 3:
            raise ValueError(f"pattern line {line!r} is too short")
        if len(f) < 6:
            dam, dcm = 100, 100
        out.append(pattern(f[0], f[2], int(f[1]), overhang, errors=errors, dam=dam, dcm=dcm, units=units, price=price))
    return out


def parse_regexes(text: str) -> list[tuple[str, str]]:
    """Lines of: name, regular expression, ! comments.  Names are cut at ten characters."""
    out = []
    for line in _body(text):
        f = line.split("!")[0].split()
        if len(f) >= 2:
            out.append((f[0][:10], f[1]))
    return out


def parse_matrices(text: str) -> list[dict]:
    """Records between // lines: NA name, AC accession, DE description, P0 header, rows of four counts."""
    out = []
    for part in re.split(r"^//.*$", text, flags=re.M):
        rows = [tuple(float(x) for x in m) for m in re.findall(r"^\d+\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)", part, flags=re.M)]
        name = re.search(r"^NA\s+(.*?)\s*$", part, flags=re.M)
        if rows and name:
            acc = re.search(r"^AC\s+(\S+)", part, flags=re.M)
            descr = re.search(r"^DE\s+(.*?)\s*$", part, flags=re.M)
            out.append({"name": name[1], "acc": acc[1] if acc else "", "descr": descr[1] if descr else "", "counts": rows})
    return out


def parse_codons(text: str) -> list[tuple[str, dict[str, str]]]:
    """Tables after ``Label X`` lines: cells of a codon, its residue's letter and its three letters."""
    out = []
    for part in re.split(r"^Label\s+", re.sub(r"^#.*$", "", text, flags=re.M), flags=re.M)[1:]:
        label, _, body = part.partition("\n")
        table = {c.lower().replace("u", "t"): aa for c, aa in re.findall(r"\b([ACGTU]{3})\s+([A-Z*])[A-Za-z]{3}\b", body)}
        if len(table) != 64:
            raise ValueError(f"codon table {label.strip()!r} has {len(table)} of 64 codons")
        out.append((label.strip(), table))
    return out


def read_patterns(spark: SparkSession, path: str) -> list[Pattern]:
    return parse_patterns(load_text(spark, path))


def read_regexes(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    return parse_regexes(load_text(spark, path))


def read_matrices(spark: SparkSession, path: str) -> list[dict]:
    return parse_matrices(load_text(spark, path))


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    return parse_rules_file(load_text(spark, path))


def read_codons(spark: SparkSession, path: str) -> list[tuple[str, dict[str, str]]]:
    return parse_codons(load_text(spark, path))


def regex_option(spark: SparkSession, text: str) -> list[tuple[str, str]]:
    """``Label:expression``, or ``FILE:path`` for all expressions of a file."""
    label, _, path = text.partition(":")
    return read_regexes(spark, path) if label == "FILE" else [command_line_regex(text)]


def command_line_regex(text: str) -> tuple[str, str]:
    """``Label:expression``."""
    label, _, rx = text.partition(":")
    if not rx:
        raise ValueError(f"{text!r} is not Label:expression")
    return label[:10], rx


def log_patterns(spark: SparkSession, patterns: list[Pattern], path: str) -> None:
    """Appends patterns that a user typed to a table, as lines of a pattern file."""
    rows = [(f"{p.name} {p.top_cut} {p.site} {p.overhang} {p.errors} {p.dam} {p.dcm} {p.units} {p.price} !",) for p in patterns]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(path)


def save(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A result table as parquet, csv or json."""
    df.write.mode("overwrite").format(form).option("header", True).save(path)
