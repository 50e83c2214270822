"""Ranked lexical search with block-max pruning over a forward index.

The index: documents lie in blocks, runs of documents in the table's order, which need no shuffle of texts.  A block
has its distinct terms, and for each document its length and its terms with their counts (the
forward index).  Once the corpus's counts are known, each block gets for each of its terms the
greatest share that the term gives to a document of the block.

The search: a query's bound in a block is the sum of its terms' weights times those maxima.
First the FIRST blocks of each query with the highest bounds are scored; the k-th best score of theirs is
the query's threshold.  Blocks whose bound is below it are never read again.  The others are
sorted by bound in each task and scored while their bound reaches the threshold, which rises with
each block that the task has scored.  A bound is never less than a score of its block, so the
result is that of scoring everything, ties included.

Terms are compared as strings, never by hashes.  Queries go in groups of about QUERY_BYTES bytes of text (a query is never split),
so what tasks are sent doesn't grow with the query table; each group is a pass over the index.

Defined results: a null or empty text, or one without a term, counts nowhere and is never found; a
query without terms has no rows; query rows that share an id (null is one, too) are one query with the terms of all of
them; rows that repeat a doc_id are documents each; of equal scores the smaller doc_id comes first,
null last, and rows that share score and doc_id come in any order; an empty table on either side gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IN_TOKEN, chunks, dropped, id_and_text, task, trimmed, written
from .wordbags import bags

#: Bytes of text in a block (a longer text is a block of its own), and at most so many documents.
BLOCK_BYTES, BLOCK_DOCUMENTS = 1 << 20, 512
#: Blocks, and heads of blocks, in a file of the index: what a task holds at once doesn't grow with its share of the table.
FILE_BLOCKS, FILE_HEADS = 16, 64
#: Bytes of query text in a pass.
QUERY_BYTES = 1 << 20
#: Blocks of each query that give the first threshold.
FIRST = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BLOCK = "block long, terms array<string>, doc_ids array<long>, n array<int>, first array<int>, term array<int>, tf array<int>"
_HEAD = "block long, terms array<string>, df array<int>, most array<int>"


class Index(NamedTuple):
    """blocks: the forward index; heads: each block's terms, in how many of its documents they are, their maxima; N documents with a term, L terms in all."""

    blocks: DataFrame
    heads: DataFrame
    N: int
    L: int


def _list(values, type_: pa.DataType) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values, type=type_)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], type=pa.int32()), values.cast(type_))


def _row(block: int, **lists) -> pa.RecordBatch:
    types = {"terms": pa.string(), "doc_ids": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([block], type=pa.int64()), *(_list(v, types.get(k, pa.int32())) for k, v in lists.items())], names=["block", *lists])


def forward(docs: DataFrame) -> DataFrame:
    """The forward index as a row per block.  first: where each document's terms begin (one more than documents)."""

    def run(batches):
        made = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_DOCUMENTS):
                some = b.slice(lo, BLOCK_DOCUMENTS)
                for at, data, offsets in chunks(some.column("text"), BLOCK_BYTES):
                    bag = bags(_LOWER[data], offsets, IN_TOKEN)
                    held = np.flatnonzero(bag.n > 0)
                    if not len(held):
                        continue
                    first = np.searchsorted(bag.text, np.append(held, len(offsets)))
                    yield _row(made, terms=bag.terms.cast(pa.string()), doc_ids=some.column("doc_id").slice(at).take(pa.array(held)), n=bag.n[held], first=first, term=bag.term, tf=bag.count)
                    made += 1

    return id_and_text(docs).mapInArrow(task("lexical-search", run), _BLOCK)


def _shares(n: np.ndarray, first: np.ndarray, tf: np.ndarray, N: int, L: int) -> np.ndarray:
    """What a weight of 1 adds to a document's score for each of its terms."""
    m = 50 + 50 * n.astype(np.int64) * N // L
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, np.diff(first)))


def _arrays(b: pa.RecordBatch, k: int, *names: str) -> list[np.ndarray]:
    return [b.column(x)[k].values.to_numpy() for x in names]


def build_index(docs: DataFrame) -> Index:
    """The index of all documents, written to the shared folder."""
    blocks = written(forward(docs), "blocks", FILE_BLOCKS)
    N, L = blocks.select(F.size("doc_ids").cast("long").alias("d"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("t")).agg(F.coalesce(F.sum("d"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                n, first, term, tf = _arrays(b, k, "n", "first", "term", "tf")
                terms = b.column("terms")[k].values
                most = np.zeros(len(terms), dtype=np.int64)
                np.maximum.at(most, term, _shares(n, first, tf, N, L))
                yield _row(b.column("block")[k].as_py(), terms=terms, df=np.bincount(term, minlength=len(terms)), most=most)

    heads = written(blocks.select("block", "terms", "n", "first", "term", "tf").mapInArrow(task("lexical-search", run), _HEAD), "heads", FILE_HEADS)
    return Index(blocks, heads, N, L)


class Queries(NamedTuple):
    """A group of queries: vocabulary; the terms of all queries, one query after another, as places in it; where each begins (one more than queries)."""

    vocabulary: pa.Array
    term: np.ndarray
    first: np.ndarray

    def places(self, terms: pa.Array) -> np.ndarray:
        """The place in the vocabulary of each term, -1 if it has none."""
        import pyarrow.compute as pc

        return pc.index_in(terms, value_set=self.vocabulary).fill_null(-1).to_numpy()

    def per_query(self, values: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(values))
        return sums[self.first[1:]] - sums[self.first[:-1]]


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, terms: the distinct terms of each row's text."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at, data, offsets in chunks(b.column("text")):
                bag = bags(_LOWER[data], offsets, IN_TOKEN)
                first = np.searchsorted(bag.text, np.arange(len(offsets)))
                lists = pa.ListArray.from_arrays(pa.array(first, type=pa.int32()), bag.terms.cast(pa.string()).take(pa.array(bag.term)))
                yield pa.RecordBatch.from_arrays([b.column("item_id").slice(at, len(offsets) - 1), lists], names=["item_id", "terms"])

    return items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"item_id {kind}, terms array<string>")


def _frequencies(index: Index, queries: Queries) -> np.ndarray:
    """In how many documents each word of the vocabulary is."""

    def run(batches):
        total = np.zeros(len(queries.vocabulary), dtype=np.int64)
        for b in batches:
            for k in range(b.num_rows):
                place = queries.places(b.column("terms")[k].values)
                here = place >= 0
                total[place[here]] += b.column("df")[k].values.to_numpy()[here]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, type=pa.int64()), pa.array(total[held])], names=["place", "df"])

    out = np.zeros(len(queries.vocabulary), dtype=np.int64)
    for place, df in index.heads.select("terms", "df").mapInArrow(task("lexical-search", run), "place long, df long").groupBy("place").agg(F.sum("df")).collect():  # at most the vocabulary
        out[place] = df
    return out


def _bounds(index: Index, queries: Queries, weight: np.ndarray) -> DataFrame:
    """query, block, bound of all blocks that a query has a term in."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                place = queries.places(b.column("terms")[k].values)
                here = place >= 0
                worth = np.zeros(len(weight), dtype=np.int64)
                worth[place[here]] = weight[place[here]] * b.column("most")[k].values.to_numpy()[here]
                bound = queries.per_query(worth[queries.term])
                held = np.flatnonzero(bound > 0)
                yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(np.full(len(held), b.column("block")[k].as_py())), pa.array(bound[held])], names=["query", "block", "bound"])

    return index.heads.select("block", "terms", "most").mapInArrow(task("lexical-search", run), "query int, block long, bound long")


class Best:
    """The k best documents of a query so far; of the last ones' score perhaps more."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, least
        self.score, self.doc = np.zeros(0, dtype=np.int64), pa.array([], type=pa.int64())

    def add(self, score: np.ndarray, doc: pa.Array) -> None:
        good = np.flatnonzero(score >= self.least)
        if len(good):
            self.score, self.doc = np.append(self.score, score[good]), pa.concat_arrays([self.doc, doc.take(pa.array(good))])
            if len(self.score) > self.k:
                order = np.lexsort((self.doc.fill_null(0).to_numpy(), self.doc.is_null().to_numpy(zero_copy_only=False), -self.score))[: self.k]
                self.score, self.doc = self.score[order], self.doc.take(pa.array(order))
                self.least = max(self.least, int(self.score[-1]))


def _scored(index: Index, queries: Queries, weight: np.ndarray, chosen: DataFrame, k: int, least: np.ndarray, few: bool = False) -> DataFrame:
    """query, doc_id, score, task: the k best documents of each query in the chosen blocks (query, block, bound), from each task.

    few: the chosen ones are a bounded number for each query, so they are sent to the blocks and not these to them.
    """
    asked = chosen.groupBy("block").agg(F.collect_list(F.struct("query", "bound")).alias("asked"), F.max("bound").alias("best"))  # at most the queries of a group
    rows = (F.broadcast(asked) if few else asked).join(index.blocks, "block").sortWithinPartitions(F.desc("best")).drop("best", "block")
    N, L = index.N, index.L

    def run(batches):
        best: dict[int, Best] = {}
        for b in batches:
            for k_ in range(b.num_rows):
                told = b.column("asked")[k_].values
                query, bound = told.field("query").to_numpy(), told.field("bound").to_numpy()
                for q in query.tolist():
                    if q not in best:
                        best[q] = Best(k, max(1, int(least[q])))
                go = [q for q, x in zip(query.tolist(), bound.tolist()) if x >= best[q].least]
                if not go:
                    continue
                place = queries.places(b.column("terms")[k_].values)
                n, first, term, tf = _arrays(b, k_, "n", "first", "term", "tf")
                place = place[term]
                here = np.flatnonzero(place >= 0)
                document = np.repeat(np.arange(len(n)), np.diff(first))[here]
                worth = _shares(n, first, tf, N, L)[here] * weight[place[here]]
                place = place[here]
                of = np.zeros(len(weight), dtype=bool)
                for q in go:
                    own = queries.term[queries.first[q] : queries.first[q + 1]]
                    of[own] = True
                    hit = np.flatnonzero(of[place])
                    of[own] = False
                    score = np.bincount(document[hit], worth[hit], len(n)).astype(np.int64)  # sums below 2 ** 53
                    best[q].add(score, b.column("doc_ids")[k_].values)
        at = TaskContext.get().partitionId()
        for q, x in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x.score), q, dtype=np.int32)), x.doc, pa.array(x.score), pa.array(np.full(len(x.score), at, dtype=np.int32))], names=["query", "doc_id", "score", "task"])
        trimmed()

    return rows.mapInArrow(task("lexical-search", run), "query int, doc_id long, score long, task int")


_BEST_FIRST = (F.desc, "score"), (F.asc_nulls_last, "doc_id")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank; tasks are merged by 64s first, so one query's rows never meet all at once."""
    order = [f(c) for f, c in _BEST_FIRST]
    some = found.withColumn("_n", F.row_number().over(Window.partitionBy("query", F.pmod("task", F.lit(64))).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def _searched(index: Index, queries: Queries, k: int) -> DataFrame:
    """query, rank, doc_id, score of a group of queries."""
    df = _frequencies(index, queries)
    weight = np.array([math.floor(1000 * math.log((2 * index.N + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
    bounds = written(_bounds(index, queries, weight), "bounds")
    highest = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("_n", F.row_number().over(highest)).where(F.col("_n") <= FIRST).drop("_n")
    n = len(queries.first) - 1
    start = written(_scored(index, queries, weight, first, k, np.zeros(n, dtype=np.int64), few=True), "first")
    least = np.zeros(n, dtype=np.int64)
    for q, score in _top(start, k).where(F.col("rank") == k).select("query", "score").collect():  # a row a query
        least[q] = score
    threshold = bounds.sparkSession.createDataFrame([(int(q), int(x)) for q, x in enumerate(least)], "query int, least long")
    more = bounds.join(F.broadcast(threshold), "query").where(F.col("bound") >= F.col("least")).drop("least")
    more = more.join(F.broadcast(first.select("query", "block")), ["query", "block"], "left_anti")  # FIRST rows a query
    rest = _scored(index, queries, weight, more, k, least)
    out = written(_top(start.unionByName(rest), k).select("query", "rank", "doc_id", "score"), "found")
    dropped(start)
    dropped(bounds)
    return out


def search(index: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark = items.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    told = written(query_terms(items).select("item_id", F.explode("terms").alias("term")).distinct(), "queries")
    size = told.agg(F.coalesce(F.sum(F.octet_length("term") + 8), F.lit(0))).first()[0]
    groups = max(1, math.ceil(size / QUERY_BYTES))
    out = []
    for g in range(groups if index.N else 0):
        rows = told.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).orderBy("item_id").collect()  # about QUERY_BYTES
        if not rows:
            continue
        ids = list(dict.fromkeys(r["item_id"] for r in rows))
        number = {x: i for i, x in enumerate(ids)}
        by = sorted((number[r["item_id"]], r["term"]) for r in rows)
        coded = pa.array([t for _, t in by], type=pa.string()).dictionary_encode()
        first = np.searchsorted([q for q, _ in by], np.arange(len(ids) + 1))
        found = _searched(index, Queries(coded.dictionary, coded.indices.to_numpy().astype(np.int64), first), k)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"query int, item_id {kind}")
        out.append(found.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: all documents ranked for each item, the k best of them."""
    index = build_index(docs)
    out = search(index, items, k)
    dropped(index.blocks)
    dropped(index.heads)
    return out
