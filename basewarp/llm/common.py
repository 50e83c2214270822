"""Helpers shared by the operators: lineage cuts and byte-level text arrays."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Tables in the shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is set and driver and
    executors are one process (elsewhere executors would not see each other's files)."""
    set_there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("basewarp.shared.dir", None)
    if not set_there:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        set_there = "file://" + tempfile.mkdtemp(prefix="basewarp-")
        spark.conf.set("basewarp.shared.dir", set_there)
    return set_there


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is planned and run within deletes its shuffle files as it ends (Spark 4.1).  Else they stay on the executors' disks
    until the driver's JVM happens to collect its garbage, so the disk holds those of all steps together."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, goes when the application ends.

    file_rows: rows of a file at most (0: any), for tables whose rows are large: a task that writes holds a row group, one that
    reads a batch of rows, and neither is more than a file."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table of written() that no returned DataFrame reads any more."""
    fs, p = _path(df.sparkSession, df._table_path)
    fs.delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slots_for(rows: int, each: int, least: int = 1) -> int:
    """Groups of about ``each`` rows."""
    return max(least, math.ceil(rows / each))


# --------------------------------------------------------------------------
# What a Python worker keeps between tasks

_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """This worker's table for ``owner``, there for its next task of the same kind.  Spark hands workers from one
    operator to the next, so a worker that starts on other work drops what it had kept."""
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = {}
    return _kept[owner]


def trimmed() -> None:
    """Gives memory that Python and Arrow have freed back to the system: idle workers share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def task(owner: str, f):
    """f (batches to batches) as a worker's task of that owner."""

    def run(batches):
        kept(owner)
        try:
            yield from f(batches)
        finally:
            trimmed()

    return run


# --------------------------------------------------------------------------
# Texts as bytes

#: Bytes that end a word ``[^\x20\x09-\x0D]+``.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[list(SPACES)] = False

#: Bytes of a word ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
IN_TOKEN = np.zeros(256, dtype=bool)
IN_TOKEN[0x30:0x3A] = True
IN_TOKEN[0x41:0x5B] = True
IN_TOKEN[0x61:0x7B] = True
IN_TOKEN[0x80:] = True

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _letters() -> np.ndarray:
    table = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
    table[0x41:0x5B] = table[0x61:0x7B]  # A-Z count as a-z
    return table


_LETTERS = _letters()
_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= 1 << 22:  # else a very long text's, not kept
            _powers[base] = got
    return got[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a text column of about ``limit`` bytes, null as empty: first row, bytes, offsets from 0 (one more than rows)."""
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


#: Bytes that word_spans and word_hashes look at at once: what they hold beside words does not grow with a text.
WINDOW = 4 << 20


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per text the index of its first word (one more than texts)."""
    starts, ends = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for lo in range(0, len(data), WINDOW):
        hi = min(lo + WINDOW, len(data))
        inside = table[data[max(lo - 1, 0) : hi + 1]]  # with the neighbours
        if lo == 0:
            inside = np.append(False, inside)
        if hi == len(data):
            inside = np.append(inside, False)
        edge = np.zeros(hi - lo + 1, dtype=bool)
        edge[offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, side="right")] - lo] = True
        own = inside[1:-1]
        starts.append(np.flatnonzero(own & (~inside[:-2] | edge[:-1])) + lo)
        ends.append(np.flatnonzero(own & (~inside[2:] | edge[1:])) + lo + 1)
    first, last = np.concatenate(starts), np.concatenate(ends)
    return first, last, np.searchsorted(first, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z as a-z: differences of a prefix sum of byte values times powers of an odd base."""
    out = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = int(np.searchsorted(ends, lo + WINDOW, side="right"))
        if to > at:
            part = data[lo : int(ends[to - 1])]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_LETTERS[part] * power(_BASE, len(part)), out=sums[1:])
            out[at:to] = (sums[ends[at:to] - lo] - sums[starts[at:to] - lo]) * power(_INVERSE, len(part))[starts[at:to] - lo]
            at = to
        else:  # a word longer than the window, part by part
            total, scale = 0, 1
            for k in range(lo, int(ends[at]), WINDOW):
                part = data[k : min(k + WINDOW, int(ends[at]))]
                total += scale * int((_LETTERS[part] * power(_BASE, len(part))).sum(dtype=np.uint64))
                scale = scale * pow(_BASE, len(part), 1 << 64) & (1 << 64) - 1
            out[at] = total & (1 << 64) - 1
            at += 1
    return mixed(out)


def byte_texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lower_ascii(text: str) -> str:
    """A-Z to a-z and nothing else."""
    return text.encode().lower().decode()


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in ((f, columns[f.name]) for f in schema)], schema=schema)


def row_keys(*columns: str) -> list[Column]:
    """_bw_id and _bw_key, never null: doc_id, and a hash of these columns and of which of them or doc_id is null.  Rows
    without doc_id, or with one doc_id and different texts, are told apart by them."""
    told = [x for c in ("doc_id", *columns) for x in ((F.col(c).isNull(),) if c == "doc_id" else (F.col(c).isNull(), F.col(c).cast("string")))]
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_bw_id"), F.xxhash64(*told).alias("_bw_key")]


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only these two columns go to Python, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
