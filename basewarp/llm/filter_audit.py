"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

Each text gets a mask of the filters that it fails.  Rows are summed to cells (part, mask); a
cell stands for all its documents from there on.  Cells are unpivoted against all orders and
steps; a running bit-or over the steps before says whether an earlier filter has removed the
cell, conditional sums make the counts of a step, and a window over all orders of a filter
its total.  What is unpivoted has at most 2 ** filters rows for each part, however
many documents there are.

Whether a text is a copy of one with a smaller doc_id needs the whole table: the smallest
doc_id of each SHA-256 is found by an aggregate that sums where rows lie, and only the rows
that are first are joined to it, by digest and doc_id, so a text of which there are very many
copies is no hot key.

Defined results: a null text is empty (it fails A only, or E if it is a copy of another empty
text); a null lang is the part ''; rows that repeat doc_id and text are not copies of each other (neither has the smaller
id); a row without doc_id is no copy, nobody's original and has no label; a document counts as
good (toxic) if any of its label rows says so; an empty table has no part and gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IN_WORD, batch_of, chunks, task, written
from .wordbags import bags

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 200, 50, 3, b"#$%&*|"
_FLAGS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary())])


def _per_text(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(hit, dtype=np.int64))[offsets])


def masks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bits of A to D that each text fails."""
    bag = bags(data, offsets, IN_WORD)
    distinct = np.bincount(bag.text, minlength=len(offsets) - 1)
    upper = _per_text((data >= 0x41) & (data <= 0x5A), offsets)
    points = _per_text(data & 0xC0 != 0x80, offsets)
    odd = np.zeros(256, dtype=bool)
    odd[list(SYMBOLS)] = True
    fails = (bag.n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * bag.n, 100 * upper > MAX_UPPER_PERCENT * points, _per_text(odd[data], offsets) > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (A to D), digest (SHA-256 of the whole text) of every row."""

    def run(batches):
        for b in batches:
            for at, data, offsets in chunks(b.column("text")):
                n = len(offsets) - 1
                raw = memoryview(np.ascontiguousarray(data))
                digest = [hashlib.sha256(raw[a:z]).digest() for a, z in itertools.pairwise(offsets.tolist())]
                yield batch_of(_FLAGS, doc_id=b.column("doc_id").slice(at, n), part=b.column("part").slice(at, n), mask=masks(data, offsets), digest=digest)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text")).mapInArrow(
        task("filter-audit", run), "doc_id long, part string, mask int, digest binary"
    )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (A to E), n, good, toxic: how many documents of a part fail just these filters, and of them the good and the toxic ones."""
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias("toxic"))
    # Rows without doc_id get a number each and a mark that no label has, so they do not meet under one key.
    key = flags(docs).withColumns({"_id": F.coalesce("doc_id", F.monotonically_increasing_id()), "_none": F.col("doc_id").isNull()})
    rows = key.join(told.withColumn("_none", F.lit(False)), ["_id", "_none"], "left")
    rows = written(rows.select("doc_id", "part", "mask", "digest", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic"))), "audit")
    copy = 1 << FILTERS.index("E")
    # All rows that have an id count as copies first; then those that are not are put back.
    every = rows.groupBy("part", F.when(F.col("doc_id").isNull(), F.col("mask")).otherwise(F.col("mask") + copy).alias("mask")).agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    lowest = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL")
    first = rows.join(lowest, ["digest", "doc_id"], "left_semi").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    moved = first.select("part", F.explode(F.array(F.struct("mask", F.lit(1).alias("sign")), F.struct((F.col("mask") + copy).alias("mask"), F.lit(-1).alias("sign")))).alias("to"), "n", "good", "toxic")
    both = every.unionByName(moved.select("part", "to.mask", *((F.col("to.sign") * F.col(c)).alias(c) for c in ("n", "good", "toxic"))))
    return both.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic"))).where("n > 0")


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    cells: part, mask (bit k: fails the filter of the k-th letter), n, good, toxic; filters: one letter each, six at most (720 orders).
    """
    if not 1 <= len(set(filters)) == len(filters) <= 6:
        raise ValueError("one to six filters, one letter each")
    orders = F.array(*(F.lit("".join(x)) for x in itertools.permutations(filters)))
    long = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    bit = F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1)
    long = long.withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    fails, gone = F.col("fails") != 0, F.col("earlier") != 0
    total = lambda what, when, name: F.sum(F.when(when, F.col(what)).otherwise(F.lit(0))).alias(name)
    steps = long.groupBy("part", "filter_order", "step", "bit").agg(
        total("n", ~fails & ~gone, "kept"),
        total("n", fails & ~gone, "removed"),
        total("n", fails & gone, "redundant"),
        total("n", F.col("mask") == F.col("bit"), "unique_fails"),
        total("good", fails & ~gone, "good_lost"),
        total("toxic", fails & ~gone, "toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters A to E over whole texts, by lang."""
    return audit(cells(docs, labels))
