"""Exact dedup: a minimal perfect hash over historical distinct digests.

Texts are equal when identical after lower-casing A-Z only; null counts as empty.  Rows
of the history and new rows are first reduced to one row per digest where they lie
(largest doc_id, count), so a text that a third of all rows share moves as one row per
task.  Digests are dealt to shards; in each a minimal perfect hash has a slot for every
historical digest that holds the full digest and its winner's locator (doc_id).  A new
digest whose slot holds the same 32 bytes is a repeat of a historical text; the others
form groups of their own.

Defined results: a row without doc_id takes part and stays only if no row of its group
has an id; rows that repeat doc_id and text share one verdict, but rows that share only
doc_id, or have none, are judged each by its own text; an empty table gives an
empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, byte_texts, row_keys, slots_for, task, written
from .perfect_hash import PerfectHash

_DIGESTS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("digest", pa.binary())])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the row's key and the SHA-256 of each whole normalised text."""

    def run(batches):
        for b in batches:
            yield batch_of(_DIGESTS, doc_id=b.column("doc_id"), key=b.column("_bw_key"), digest=[hashlib.sha256(t.lower()).digest() for t in byte_texts(b.column("text"))])  # bytes.lower() is A-Z only

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_keys("text")[1]).mapInArrow(task("exact-dedup", run), "doc_id long, key long, digest binary")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), dtype=np.uint8).reshape(-1, 32)


def _ids(ids: pd.Series):
    return object if ids.isna().any() else np.int64


def _merge(shard: pd.DataFrame) -> pd.DataFrame:
    """One shard: hash the historical digests, look the new ones up, compare bytes, merge repeats."""
    old = shard["old"].to_numpy(bool)
    history, new = shard[old], shard[~old]
    full = _matrix(history["digest"])
    mph = PerfectHash(full)
    held = np.empty_like(full)  # slots: the full digest ...
    order = mph.slots(full)
    held[order] = full
    keep, size = history["keep_id"].to_numpy(_ids(history["keep_id"])), history["n"].to_numpy(np.int64)
    locator, count = np.empty_like(keep), np.empty_like(size)  # ... and the winner's locator
    locator[order], count[order] = keep, size
    asked = _matrix(new["digest"])
    slot = mph.slots(asked)
    member = slot >= 0
    member[member] = (held[slot[member]] == asked[member]).all(axis=1)
    ids, ns = new["keep_id"].to_numpy(_ids(new["keep_id"])), new["n"].to_numpy(np.int64)
    for i in np.flatnonzero(member):  # distinct digests: at most one row for a slot
        s = slot[i]
        count[s] += ns[i]
        locator[s] = max((x for x in (locator[s], ids[i]) if not pd.isna(x)), default=None)
    return pd.DataFrame(
        {
            "digest": [*(x.tobytes() for x in held), *(x.tobytes() for x in asked[~member])],
            "keep_id": pd.array([*locator, *ids[~member]], dtype="Int64"),
            "group_size": np.concatenate([count, ns[~member]]),
            "known": np.concatenate([np.ones(len(held), dtype=bool), np.zeros(int((~member).sum()), dtype=bool)]),
        }
    )


def groups(found: DataFrame, is_history: Column, rows: int, shard_rows: int = 20_000) -> DataFrame:
    """One row per distinct digest: digest, keep_id, group_size, known (in the history).  found: doc_id, digest."""
    shards = slots_for(rows, shard_rows, 64)
    each = found.groupBy("digest", is_history.alias("old")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    each = each.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    return each.groupBy("shard").applyInPandas(_merge, "digest binary, keep_id long, group_size long, known boolean")


def _judged(docs: DataFrame, is_history: Column | None, rows: int | None) -> DataFrame:
    """exact_dedup's columns and the row's key."""
    if is_history is None:
        is_history = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    found = written(digests(docs), "digests")
    rows = found.count() if rows is None else rows
    verdict = groups(found, F.coalesce(is_history, F.lit(False)), rows)
    joined = found.join(verdict.hint("merge"), "digest")  # AQE splits the hot digest's rows
    return joined.select("key", "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, is_history: Column | None = None, rows: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    is_history: which rows (by doc_id) form the historical set; by default the ids of even CRC-32.
    """
    return _judged(docs, is_history, rows).drop("key")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    verdict = _judged(docs, None, None).where("kept").select(F.coalesce("doc_id", F.lit(0)).alias("_bw_id"), F.col("key").alias("_bw_key")).distinct()
    return docs.select("*", *row_keys("text")).join(verdict, ["_bw_id", "_bw_key"], "left_semi").drop("_bw_id", "_bw_key")
