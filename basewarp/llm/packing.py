"""Best-fit packing in bulk-synchronous supersteps: documents and gaps sorted together, matched by successor sweeps.

Pieces are packed by classes of size, the largest first (``CLASSES``), so small pieces are still there for what
the large ones leave.  Of each class, supersteps place all pieces; one that places none opens as many new sequences as the
waiting pieces need at least.  A superstep:

1. Range sort: unplaced pieces and gaps are dealt to ranges of (size, kind, number) and sorted; a piece
   stands before the gaps of its own size.
2. Sweep: every task goes up its range.  Pieces wait on a stack; a gap takes the largest waiting
   piece, which is thus a piece for which this gap is the successor, and the next ones as long as they fit.
3. Over range edges: a task that ends with waiting pieces, or has met gaps while none waited, numbers them
   by rank.  From one row of counts per range the driver deals ranks of waiting pieces to ranks of gaps in
   later ranges, the same stack rule on ranges: a gap gets as many pieces as fit by the range's greatest
   piece and the other range's least gap.  Ranks differ, so no gap is claimed twice; a join brings both together.
4. Gaps are reduced, those that are full go, those below every piece of the class wait for the next class, and the
   next superstep begins.

Once a class and its gaps, or all that is left, are no more than one range holds, one task repeats the supersteps on them.
Pieces as long as the capacity are sequences of their own.  Every superstep's results are a written
table; the driver holds one row per range, of which there are at most ``RANGES``.

Defined results: null text is empty, so it is the end token alone; equal lengths are
ordered by the piece's number; repeated rows are packed each; an empty table gives an
empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_of, id_and_text, slots_for, task, written
from .tokens import encoder, tokenizer_path

CAPACITY = 2048
#: Rows of a range, and the most ranges (at more rows than their product ranges grow).
RANGE_ROWS, RANGES = 16_384, 65_536
#: Classes of pieces: above a half, a third, a sixth, a sixteenth of the capacity, and the rest.
CLASSES = (2, 3, 6, 16)
#: Pieces above 1/2, 1/3, ... of the capacity are counted: at most one, two, ... of them share a sequence.
SHARES = 7
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("number", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece.  Of a text longer than the capacity all pieces are full but the first, which takes the rest."""

    def run(batches):
        enc = encoder(tokenizer)
        number = TaskContext.get().partitionId() << 36
        for b in batches:
            names = b.column("doc_id").to_pylist()
            for at, ids, begins in enc.encoded(b.column("text")):
                size = np.diff(begins) + 1
                tokens = np.full(int(size.sum()), end_id, dtype="<u4")
                ends = np.cumsum(size)
                body = np.ones(len(tokens), dtype=bool)
                body[ends - 1] = False
                tokens[body] = ids
                raw = memoryview(tokens).cast("B")
                out: list[tuple] = []
                for k, (lo, hi) in enumerate(zip((ends - size).tolist(), ends.tolist())):
                    cut = lo + ((hi - lo - 1) % capacity) + 1
                    for piece, (a, z) in enumerate(zip((lo, *range(cut, hi, capacity)), range(cut, hi + 1, capacity))):
                        out.append((names[at + k], piece, a - lo, z - a, zlib.crc32(raw[4 * a : 4 * z]), number))
                        number += 1
                yield batch_of(_PIECES, **{f.name: list(c) for f, c in zip(_PIECES, zip(*out))})

    return id_and_text(docs).mapInArrow(task("tokens", run), "doc_id long, piece int, start long, length int, ids_crc32 long, number long")


#: What a sweep says of a row: a piece placed, a piece that waits, a gap that no piece has reached, a gap that was reduced.
_PLACED, _WAITS, _FREE, _REDUCED = range(4)
_SWEPT = pa.schema([("range", pa.int32()), ("said", pa.int8()), ("number", pa.int64()), ("size", pa.int32()), ("sequence", pa.int64()), ("offset", pa.int32()), ("rank", pa.int64())])
_SWEPT_SQL = "range int, said tinyint, number long, size int, sequence long, offset int, rank long"
_STATE = "number long, size int, gap boolean"


class Sweep:
    """Goes up sorted rows (number, size, gap) and says what becomes of each."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.waiting: list[tuple[int, int]] = []
        self.free = 0

    def rows(self, number: list[int], size: list[int], gap: list[bool]):
        """(said, number, size, sequence, offset, rank) of the rows' pieces placed and gaps."""
        waiting, capacity = self.waiting, self.capacity
        for n, room, is_gap in zip(number, size, gap):
            if not is_gap:
                waiting.append((n, room))
            elif waiting:
                while waiting and waiting[-1][1] <= room:
                    piece, length = waiting.pop()
                    yield _PLACED, piece, length, n, capacity - room, 0
                    room -= length
                if room:
                    yield _REDUCED, 0, room, n, 0, 0
            else:
                yield _FREE, 0, room, n, 0, self.free
                self.free += 1

    def rest(self):
        """The waiting pieces, the largest first."""
        for rank, (n, length) in enumerate(reversed(self.waiting)):
            yield _WAITS, n, length, 0, 0, rank


def _swept(rows, part: int) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 6
    return batch_of(_SWEPT, range=np.full(len(columns[0]), part, dtype=np.int32), **{f.name: list(c) for f, c in zip(list(_SWEPT)[1:], columns)})


def _sweep(batches, capacity: int):
    part, sweep = TaskContext.get().partitionId(), Sweep(capacity)
    for b in batches:
        yield _swept(sweep.rows(*(b.column(c).to_pylist() for c in ("number", "size", "gap"))), part)
    yield _swept(sweep.rest(), part)


def least_sizes(capacity: int) -> list[int]:
    """The least piece of each class, from the largest class down."""
    return [*sorted({capacity // k + 1 for k in CLASSES} - {1}, reverse=True), 1]


def needed(tokens: int, above: list[int], capacity: int) -> int:
    """Sequences that waiting pieces need at least; above: how many are larger than 1/2, 1/3, ... of the capacity."""
    return max(-(-tokens // capacity), *(-(-n // k) for k, n in enumerate(above, 1)))


def _finish(batches, capacity: int, opened: int):
    """All supersteps on the rows of one task, class by class; the gaps that remain are said to be free."""
    pieces: list[tuple[int, int]] = []
    gaps: list[tuple[int, int]] = []
    for b in batches:
        for size, gap, number in zip(*(b.column(c).to_pylist() for c in ("size", "gap", "number"))):
            (gaps if gap else pieces).append((size, number))
    for least in least_sizes(capacity):
        own, pieces = [x for x in pieces if x[0] >= least], [x for x in pieces if x[0] < least]
        while own:
            floor = min(own)[0]
            state = sorted([(s, False, n) for s, n in own] + [(s, True, n) for s, n in gaps if s >= floor])
            gaps = [x for x in gaps if x[0] < floor]
            sweep = Sweep(capacity)
            out = list(sweep.rows([x[2] for x in state], [x[0] for x in state], [x[1] for x in state]))
            placed = [x for x in out if x[0] == _PLACED]
            yield _swept(placed, 0)
            own = [(x[2], x[1]) for x in sweep.rest()]
            gaps += [(x[2], x[3]) for x in out if x[0] in (_FREE, _REDUCED)]
            if own and not placed:
                sizes = np.array([s for s, _ in own])
                more = needed(int(sizes.sum()), [int((sizes > capacity // (k + 1)).sum()) for k in range(1, SHARES + 1)], capacity)
                gaps += [(capacity, opened + k) for k in range(more)]
                opened += more
    yield _swept([(_FREE, 0, room, number, 0, 0) for room, number in gaps], 0)


def deal(counts: np.ndarray) -> np.ndarray:
    """Ranks of waiting pieces dealt to ranks of free gaps: rows (piece range, first rank, pieces, pieces a gap, gap range, first gap).

    counts: rows (range, waiting pieces, greatest of them, free gaps, least of them), by range.
    """
    out: list[tuple[int, ...]] = []
    stack: list[list[int]] = []  # range, next rank, pieces left, greatest
    for part, waits, greatest, free, least in counts.tolist():
        gap = 0
        while free - gap and stack:  # a range's free gaps come before its waiting pieces
            top = stack[-1]
            each = max(1, least // top[3])
            taken = min(top[2], each * (free - gap))
            out.append((top[0], top[1], taken, each, part, gap))
            gap += -(-taken // each)
            top[1] += taken
            top[2] -= taken
            if not top[2]:
                stack.pop()
        if waits:
            stack.append([part, 0, waits, greatest])
    return np.array(out, dtype=np.int64).reshape(-1, 6)


_DEALT = pa.schema([("number", pa.int64()), ("size", pa.int32()), ("to_range", pa.int32()), ("to_rank", pa.int64()), ("turn", pa.int64())])


def _claims(batches, runs: np.ndarray):
    """Each waiting piece with the gap that its rank is dealt to (null if to none) and its turn there."""
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    for b in batches:
        part, rank = b.column("range").to_numpy().astype(np.int64), b.column("rank").to_numpy()
        at = np.full(len(part), -1)
        first, last = np.searchsorted(runs[:, 0], part), np.searchsorted(runs[:, 0], part, side="right")
        for own in np.unique(part):  # a task's rows are of few ranges
            mine = np.flatnonzero(part == own)
            lo, hi = first[mine[0]], last[mine[0]]
            at[mine] = lo - 1 + np.searchsorted(runs[lo:hi, 1], rank[mine], side="right") if hi > lo else -1
            at[mine[at[mine] < lo]] = -1
        run = runs[at] if len(runs) else np.zeros((len(part), 6), dtype=np.int64)
        k = rank - run[:, 1]
        none = (at < 0) | (k >= run[:, 2])
        each = np.maximum(run[:, 3], 1)
        yield batch_of(_DEALT, number=b.column("number"), size=b.column("size"), to_range=pa.array(run[:, 4].astype(np.int32), mask=none), to_rank=pa.array(run[:, 5] + k // each, mask=none), turn=pa.array(k % each, mask=none))


def _superstep(spark: SparkSession, state: DataFrame, rows: int, capacity: int, range_rows: int) -> tuple[DataFrame, DataFrame]:
    """(placed: number, sequence, offset; the next state)."""
    parts = min(slots_for(rows, range_rows), RANGES)
    ordered = state.repartitionByRange(parts, "size", "gap", "number").sortWithinPartitions("size", "gap", "number")
    swept = written(ordered.mapInArrow(task("packing", lambda bs: _sweep(bs, capacity)), _SWEPT_SQL), "swept")
    waits, free = F.col("said") == _WAITS, F.col("said") == _FREE
    sums = swept.where(waits | free).groupBy("range").agg(F.count(F.when(waits, 1)).alias("w"), F.max(F.when(waits, F.col("size"))).alias("wm"), F.count(F.when(free, 1)).alias("f"), F.min(F.when(free, F.col("size"))).alias("fm"))
    table = sums.orderBy("range").toArrow()  # one row per range
    runs = spark.sparkContext.broadcast(deal(np.stack([c.fill_null(0).to_numpy().astype(np.int64) for c in (table.column(i).combine_chunks() for i in range(5))], axis=1)))

    pieces = swept.where(waits).select("range", "number", "size", "rank").mapInArrow(task("packing", lambda bs: _claims(bs, runs.value)), "number long, size int, to_range int, to_rank long, turn long")
    gaps = swept.where(free).select("range", "rank", "sequence", F.col("size").alias("room"))
    own = pieces.where("to_range IS NOT NULL")
    met = gaps.join(own, (F.col("to_range") == F.col("range")) & (F.col("to_rank") == F.col("rank")), "left")
    so_far = Window.partitionBy("range", "rank").orderBy("turn")
    met = met.withColumn("used", F.sum("size").over(so_far)).withColumn("last", F.lead("turn").over(so_far).isNull())
    # Pieces that are dealt to no gap meet nothing and would all have one key.
    claimed = written(met.unionByName(pieces.where("to_range IS NULL"), allowMissingColumns=True), "claimed")

    to = F.col("sequence")
    offset = (F.lit(capacity) - F.col("room") + F.col("used") - F.col("size")).cast("int").alias("offset")
    placed = swept.where(F.col("said") == _PLACED).select("number", "sequence", "offset").unionByName(claimed.where("sequence IS NOT NULL AND number IS NOT NULL").select("number", "sequence", offset))
    left = [
        swept.where(F.col("said") == _REDUCED).select(to.alias("number"), "size", F.lit(True).alias("gap")),
        claimed.where("sequence IS NULL").select("number", "size", F.lit(False).alias("gap")),
        claimed.where("sequence IS NOT NULL AND last").select(to.alias("number"), (F.col("room") - F.coalesce("used", F.lit(0))).cast("int").alias("size"), F.lit(True).alias("gap")).where("size > 0"),
    ]
    return placed, functools.reduce(DataFrame.unionByName, left)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Sequences of one whole piece have negative ids."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer or tokenizer_path("byte_bpe_50k.json"), capacity), "pieces")
    placed = place(spark, cut.where(F.col("length") < capacity).select("number", F.col("length").alias("size")), capacity, range_rows)
    columns = ["doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32"]
    whole = cut.where(F.col("length") == capacity).select(*columns, (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return cut.join(placed, "number").select(*columns, F.col("sequence").alias("sequence_id"), F.col("offset").cast("long").alias("offset")).unionByName(whole)


def _no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """createDataFrame([]) is an RDD of pickled rows and keeps plain Python workers on the executors, beside those for Arrow."""
    return spark.range(0, 0, 1, 1).select(*(F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in schema.split(", "))))


def place(spark: SparkSession, sizes: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """number, sequence, offset of every piece.  sizes: number, size (below the capacity)."""
    pieces, size = sizes.select("number", "size", F.lit(False).alias("gap")), F.col("size")
    gaps, opened, upper = _no_rows(spark, _STATE), 0, capacity
    placed = [_no_rows(spark, "number long, sequence long, offset int")]
    above = [F.count_if(size > capacity // (k + 1)).alias(f"above{k}") for k in range(1, SHARES + 1)]

    def finished(state: DataFrame) -> DataFrame:
        swept = written(state.coalesce(1).mapInArrow(task("packing", lambda bs, opened=opened: _finish(bs, capacity, opened)), _SWEPT_SQL), "swept")
        placed.append(swept.where(F.col("said") == _PLACED).select("number", "sequence", "offset"))
        return swept.where(F.col("said") == _FREE).select(F.col("sequence").alias("number"), "size", F.lit(True).alias("gap"))

    for least in least_sizes(capacity):
        rest = pieces.where(size < upper).unionByName(gaps)
        if rest.count() <= range_rows:
            finished(rest)
            break
        state, kept_gaps, before = rest.where(F.col("gap") | (size >= least)), [], None
        while True:
            left = state.where("NOT gap").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens"), F.min("size").alias("least"), *above).first()
            if not left["n"]:
                kept_gaps.append(state)
                break
            kept_gaps.append(state.where(F.col("gap") & (size < left["least"])))
            state = state.where(~F.col("gap") | (size >= left["least"]))
            if left["n"] == before or not opened:  # none was placed
                more = needed(left["tokens"], [left[f"above{k}"] for k in range(1, SHARES + 1)], capacity)
                state = state.unionByName(spark.range(opened, opened + more).select(F.col("id").alias("number"), F.lit(capacity).cast("int").alias("size"), F.lit(True).alias("gap")))
                opened += more
            before, rows = left["n"], state.count()
            if rows <= range_rows:
                kept_gaps.append(finished(state))
                opened += before  # at most as many new ones as pieces
                break
            some, state = _superstep(spark, state, rows, capacity, range_rows)
            placed.append(some)
        upper = least
        gaps = written(functools.reduce(DataFrame.unionByName, kept_gaps), "gaps")
    return functools.reduce(DataFrame.unionByName, placed)
