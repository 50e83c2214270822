"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, ...; their shares of
   all words stop at ``most`` times the source's words, the excess goes to the others by
   weight until none is above.  Sources are a table: they are numbered by a range sort, and each
   round of sharing is one sum over them.
2. Blocks: a seeded hash of the row permutes each source; equal ranges of that hash are
   the source's blocks (about ``block_rows`` rows each, so a hot source is many blocks).  A block's
   quota are the copies that running sums over blocks ask of it.
3. Splitting tree: the source's block copies are quotas at the root over all output shards; each
   node draws its left half's quotas from a multivariate hypergeometric law (seeded by the
   node), down to single shards.  The tree on the driver splits ``GROUPS`` groups of sources; in
   each group a task draws its shards' parts among its sources by the same law, which together
   is the law for all sources.  Every shard draws the next blocks of each source's permutation, so
   blocks are disjoint.  What the shards draw is what the mix takes; only the one block that a
   target cuts is filled document by document.
4. Within a shard, copies are ordered by a seeded hash.

Nothing on the driver grows with documents or sources.  Tables of sources are sent to all tasks
while they have at most ``SENT`` rows and bytes in ``SENT_BYTES``, and joined by shuffle beyond.

Defined results: null text has size 0; null sources mix as one source after the others;
a source without words has target 0 and its rows are taken 0 times; rows that repeat doc_id, text
and source get equal hashes, lie in one block and are told apart by nothing; an empty
table gives an empty result; columns besides doc_id, text and source are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_keys, slots_for, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
SEED = 11
GROUPS = 256
SENT, SENT_BYTES = 100_000, 8_000_000
_LOW = (1 << 33) - 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, groups) block quotas: each node of a binary tree over shards draws its left part without replacement."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def node(lo: int, hi: int, held: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = held
            return
        mid = (lo + hi) // 2
        left = draw([seed, lo, hi], held, int(held.sum()) * (mid - lo) // (hi - lo))
        node(lo, mid, left)
        node(mid, hi, held - left)

    node(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


def draw(seed: list[int], held: np.ndarray, n: int) -> np.ndarray:
    """n of the held blocks without replacement; "marginals" is exact and needs memory only for the sources."""
    return np.random.default_rng(seed).multivariate_hypergeometric(held, n, method="marginals") if held.sum() else held


def _deal(frame: pd.DataFrame, seed: int) -> pd.DataFrame:
    """One group: what each shard draws from the group, drawn among its sources; ends[s] is a source's first block after shard s."""
    frame = frame.sort_values("place", ignore_index=True)
    left = frame["quota"].to_numpy(np.int64)
    drawn = []
    for shard, n in enumerate(frame["drawn"].iloc[0]):
        own = draw([seed, int(frame["bunch"].iloc[0]), shard], left, int(n))
        drawn.append(own)
        left = left - own
    ends = np.cumsum(drawn, axis=0)
    return pd.DataFrame({"source": frame["source"], "ends": list(ends.T)})


def _fill(block: pd.DataFrame) -> pd.DataFrame:
    """One block: in the permutation's order, documents that still fit in the room; then exchanges that bring the sum nearer."""
    block = block.sort_values(["perm", "doc_id", "size"], ignore_index=True)
    room, size = float(block["room"].iloc[0]), block["size"].to_numpy(np.int64)
    more = np.zeros(len(block), dtype=bool)
    for i, n in enumerate(size.tolist()):
        if 0 < n <= room:
            room -= n
            more[i] = True
    while True:  # then the one addition or exchange of sizes that comes nearest, while it comes nearer
        inside, outside = np.unique(size[more]), np.unique(size[(size > 0) & ~more])
        if not len(outside):
            return block.assign(more=more)
        given = np.append(0, inside)  # 0: only add
        want = room + given
        k = np.searchsorted(outside, want)
        near = np.stack([outside[np.maximum(k - 1, 0)], outside[np.minimum(k, len(outside) - 1)]])
        miss = np.abs(want - near)
        way, at = np.unravel_index(int(np.argmin(miss)), miss.shape)
        if miss[way, at] >= abs(room):
            return block.assign(more=more)
        a, b = int(given[at]), int(near[way, at])
        more[np.flatnonzero(~more & (size == b))[0]] = True
        if a:
            more[np.flatnonzero(more & (size == a))[-1]] = False
        room += a - b


def _numbered(sources: DataFrame, n: int) -> DataFrame:
    """Sources with their place in code-point order, null last."""
    last = F.col("source").isNull()
    ordered = sources.repartitionByRange(slots_for(n, 50_000), last, "source").sortWithinPartitions(last, "source")
    ordered = written(ordered.withColumn("in_order", F.monotonically_increasing_id()), "sources")  # numbers rows of a task, tasks in 33 bits
    part = F.shiftright("in_order", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row per 50,000 sources
    before = dict(zip([r["part"] for r in counts], np.cumsum([0, *(r["n"] for r in counts)]).tolist()))
    spark = sources.sparkSession
    offsets = F.broadcast(spark.createDataFrame(pa.table({"part": pa.array(list(before), pa.int64()), "before": pa.array(list(before.values()), pa.int64())})))
    return ordered.join(offsets, part == F.col("part")).withColumn("place", F.col("before") + F.col("in_order").bitwiseAND(F.lit(_LOW))).drop("part", "before", "in_order")


def with_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sources (source, source_size, rows) with place and target."""
    table = _numbered(sources, sources.count())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)
    table = written(table.withColumn("weight", weight), "weights")
    full, words, share = F.lit(False), F.col("source_size"), None
    before = -1
    while True:
        sums = table.where("source_size > 0").agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.lit(most) * words)).alias("spent"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count(F.when(full, 1)).alias("full")).first()
        if sums["weight"] is None or sums["full"] == before:
            break
        before, left = sums["full"], float(sums["all"]) - (sums["spent"] or 0.0)
        share = F.lit(left) * F.col("weight") / F.lit(sums["weight"])
        full = full | (share > F.lit(most) * words)
    target = F.when(words == 0, 0.0).when(full, F.lit(most) * words)
    return table.withColumn("target", target.otherwise(share) if share is not None else target)


def _planned(docs: DataFrame, out_shards: int, block_rows: int, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    """mix's columns and the row's keys."""
    spark: SparkSession = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *row_keys("text", "source"))
    slim = written(slim.withColumn("perm", F.xxhash64(F.lit(seed), "_bw_id", "_bw_key")), "sizes")

    per_source = written(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "per-source")
    extent = per_source.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("source")).alias("bytes")).first()
    small = extent["n"] <= SENT and (extent["bytes"] or 0) <= SENT_BYTES
    recipe = with_targets(per_source, weights, most)
    recipe = written(recipe.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")).withColumn("n_blocks", F.ceil(F.col("rows") / F.lit(block_rows))), "recipe")

    def by_source(df: DataFrame, table: DataFrame) -> DataFrame:
        table = table.withColumnRenamed("source", "t_source")
        return df.join(F.broadcast(table) if small else table.hint("merge"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")

    # Equal ranges of the permuting hash are blocks; within one, rows follow the hash.
    block = F.floor((F.col("perm") / F.lit(float(1 << 64)) + F.lit(0.5)) * F.col("n_blocks"))
    rows = by_source(slim, recipe.select("source", "source_size", "target", "whole", "n_blocks")).withColumn("block", F.least(F.greatest(block, F.lit(0)), F.col("n_blocks") - 1))

    in_order = Window.partitionBy("source").orderBy("block")
    by_block = rows.groupBy("source", "block", "source_size", "target", "whole").agg(F.sum("size").alias("words"))
    by_block = by_block.withColumn("before", F.coalesce(F.sum("words").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("block_no", F.row_number().over(in_order) - 1)
    # A block's quota: "whole" copies, and one more if the rest of the target reaches it.
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    by_block = written(by_block.withColumn("quota", F.col("whole") + (F.col("before") < rest).cast("int")), "blocks")

    quotas = by_block.groupBy("source").agg(F.sum("quota").alias("quota"), F.count(F.lit(1)).alias("used"))
    quotas = by_source(quotas, recipe.select("source", "place")).withColumn("bunch", F.pmod(F.xxhash64("source"), F.lit(GROUPS)).cast("int"))
    quotas = written(quotas, "quotas")
    held = np.zeros(GROUPS, dtype=np.int64)
    for r in quotas.groupBy("bunch").agg(F.sum("quota").alias("n")).collect():
        held[r["bunch"]] = r["n"]
    drawn = split(held, out_shards, seed)
    bunches = np.flatnonzero(held)
    # From Arrow: rows of Python objects are an RDD that plain Python workers read, beside those for Arrow.
    parts = F.broadcast(spark.createDataFrame(pa.table({"bunch": pa.array(bunches, pa.int32()), "drawn": pa.array([drawn[:, g] for g in bunches], pa.list_(pa.int64()))})))
    ends = quotas.join(parts, "bunch").groupBy("bunch").applyInPandas(lambda f: _deal(f, seed), "source string, ends array<long>")
    ends = written(ends, "ends")

    # A copy's number in the source's permutation: all blocks in order, once more round for each further copy.
    copies = by_block.where("quota > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("quota") - 1)))
    copies = by_source(by_source(copies, quotas.select("source", "used")).withColumn("no", F.col("copy") * F.col("used") + F.col("block_no")), ends)
    shard = F.size(F.filter("ends", lambda end: end <= F.col("no")))
    places = copies.groupBy("source", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("copy", shard.alias("shard")))), lambda x: x["shard"]).alias("shards"))
    at = by_block.select(F.col("source").alias("a_source"), F.col("block").alias("a_block"), "before", "words")
    places = places.withColumnsRenamed({"source": "p_source", "block": "p_block"})
    at = at.join(places, F.col("a_source").eqNullSafe(F.col("p_source")) & (F.col("a_block") == F.col("p_block")), "left").drop("p_source", "p_block")
    joined = rows.join(at, F.col("source").eqNullSafe(F.col("a_source")) & (F.col("block") == F.col("a_block"))).drop("a_source", "a_block").withColumn("room", rest - F.col("before"))
    # Copies are what the shards have drawn; of the block in which the target ends, the last draw is filled document by document.
    cut = (F.col("room") > 0) & (F.col("room") < F.col("words"))
    joined = joined.withColumn("shards", F.coalesce("shards", F.array().cast("array<int>"))).withColumn("more", F.lit(True))
    filled = joined.where(cut).groupBy("source", "block").applyInPandas(_fill, joined.schema)
    out = joined.where(~cut).unionByName(filled).withColumn("copies", F.when(F.col("target") > 0, F.size("shards") - (~F.col("more")).cast("int")).otherwise(0))
    return out.select(
        "_bw_id", "_bw_key", "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.col("copies").cast("int"), F.when(F.col("copies") > 0, F.slice("shards", F.lit(1), F.col("copies"))).alias("shards"), F.xxhash64(F.lit(seed + 1), "_bw_id", "_bw_key").alias("place")
    )


def mix(docs: DataFrame, out_shards: int = 64, block_rows: int = 2_000, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, and copies, shards (of each copy), place (the order in a shard)."""
    return _planned(docs, out_shards, block_rows, weights, most, seed).drop("_bw_id", "_bw_key")


def mixed_rows(docs: DataFrame, out_shards: int = 64) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes them, shard by shard and shuffled within."""
    plan = _planned(docs, out_shards, 2_000, WEIGHTS, MOST, SEED).where("copies > 0")
    # Rows that repeat doc_id, text and source have a plan each; which row gets which is all the same.
    plans = plan.groupBy("_bw_id", "_bw_key").agg(F.collect_list(F.struct("shards", "place")).alias("_bw_plans"))
    numbered = docs.select("*", *row_keys("text", "source")).withColumn("_bw_no", F.row_number().over(Window.partitionBy("_bw_id", "_bw_key").orderBy(F.lit(0))) - 1)
    taken = numbered.join(plans, ["_bw_id", "_bw_key"]).withColumn("_bw_plan", F.get("_bw_plans", F.col("_bw_no"))).withColumn("_bw_place", F.col("_bw_plan.place"))
    again = taken.select("*", F.posexplode("_bw_plan.shards").alias("_bw_copy", "_bw_shard"))
    return again.repartition(out_shards, "_bw_shard").sortWithinPartitions("_bw_shard", "_bw_place", "_bw_copy").drop("_bw_id", "_bw_key", "_bw_no", "_bw_plans", "_bw_plan", "_bw_place", "_bw_copy", "_bw_shard")
