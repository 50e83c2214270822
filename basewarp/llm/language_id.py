"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every training row; tasks emit one row per language and
bucket they met, and Spark adds them.  The log-probability matrix of at most ``MAX_LANGS``
languages is made on the driver and broadcast; more languages are scored in several passes over the
texts, whose best languages and masses are joined by row.  Scoring multiplies the sparse matrix of a
batch's bucket counts with it in numpy.

Defined results: null text, or text without a letter, is ``und`` with score 0; rows with
null lang or null doc_id never train (a null doc_id is scored as not held out); without
any training row everything is ``und``; equal scores go to the first language in
code-point order; repeated rows are predicted alike; columns besides doc_id, text and
lang are not read, and lang is read for training only.  A text goes in steps of a fixed number
of characters, so a very long one needs memory for its characters only.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chargrams import gram_runs, segment_sums
from .common import batch_of, task, written

ORDERS, BITS, SMOOTHING = (2, 3), 15, 0.5
#: Languages of one pass: bounds what comes to the driver (65,537 rows a language) and the matrix sent (0.5 MB a language).
MAX_LANGS = 64
UNDETERMINED = "und"
#: Rows whose texts are Python strings at once, and characters whose n-grams are arrays at once: bounds of a worker's memory.
SLICE_ROWS, RUN = 1_000, 1 << 18

_COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Model:
    """Languages in code-point order; (2**BITS + 1, languages) log-probabilities per order (last row: no n-gram), log priors."""

    def __init__(self, langs: list[str], rows: list[np.ndarray], prior: np.ndarray):
        self.langs, self.rows, self.prior = langs, rows, prior


def _slices(batches):
    for b in batches:
        for lo in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(lo, SLICE_ROWS)


def _count(batches):
    """Counts of a task.  At most MAX_LANGS languages are held at a time; beyond, what is held goes out and counting starts anew,
    so memory doesn't follow the number of languages."""
    width = (1 << BITS) + 1
    counts: dict[str, np.ndarray] = {}

    def held_ones():
        for lang, held in counts.items():
            at = np.flatnonzero(held)
            yield batch_of(_COUNTS, lang=[lang] * len(at), bucket=at.astype(np.int32), n=held[at])
        counts.clear()

    for b in _slices(batches):
        by: dict[str, list[str]] = {}
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
            by.setdefault(lang, []).append(text or "")
        for lang, own in by.items():
            if lang not in counts and len(counts) >= MAX_LANGS:
                yield from held_ones()
            held = counts.setdefault(lang, np.zeros(len(ORDERS) * width + 1, dtype=np.int64))
            held[-1] += len(own)
            for _, _, grams, which in gram_runs(own, ORDERS, RUN):
                for k in which:
                    held[k * width : (k + 1) * width] += np.bincount(grams.hashed(ORDERS[k], BITS), minlength=width)
    yield from held_ones()


def train(docs: DataFrame, is_training: Column) -> list[Model]:
    """Learns from the rows of docs for which is_training holds and lang is not null: a model for each run of MAX_LANGS languages."""
    rows = docs.where(is_training & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    total = written(rows.mapInArrow(task("language-id", _count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")
    width = (1 << BITS) + 1
    known = total.where(F.col("bucket") == len(ORDERS) * width).select("lang", "n").toArrow()
    rows_of = dict(zip(known.column("lang").to_pylist(), known.column("n").to_pylist()))
    langs, models = sorted(rows_of), []
    for lo in range(0, len(langs), MAX_LANGS):
        own = langs[lo : lo + MAX_LANGS]
        got = total.where(F.col("lang").between(own[0], own[-1])).toArrow()
        counts = np.zeros((len(own), len(ORDERS) * width + 1))
        counts[np.searchsorted(np.array(own, dtype=object), np.array(got.column("lang").to_pylist(), dtype=object)), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
        tables = []
        for k in range(len(ORDERS)):
            n = counts[:, k * width : (k + 1) * width - 1] + SMOOTHING
            logs = np.log(n) - np.log(n.sum(axis=1, keepdims=True))
            tables.append(np.ascontiguousarray(np.vstack([logs.T, np.zeros((1, len(own)))])))
        models.append(Model(own, tables, np.log([max(rows_of[x], 1) for x in own]) - np.log(max(sum(rows_of.values()), 1))))
    return models


def scores(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the best language, its posterior probability, its score, and the mass of all languages against it."""
    total = np.tile(model.prior, (len(texts), 1))
    lettered = np.zeros(len(texts), dtype=bool)
    for at, n, grams, which in gram_runs(texts, ORDERS, RUN):
        lettered[at : at + n] |= grams.lettered
        for k in which:
            total[at : at + n] += segment_sums(grams, ORDERS[k], BITS, model.rows[k])
    top, best = total.max(axis=1), total.argmax(axis=1)
    mass = np.exp(total - top[:, None]).sum(axis=1)
    return [model.langs[i] if ok else UNDETERMINED for i, ok in zip(best, lettered)], np.where(lettered, 1 / mass, 0.0), top, mass


_SCORED = pa.schema([("row", pa.int64()), ("lang", pa.string()), ("top", pa.float64()), ("mass", pa.float64())])


def _by_passes(numbered: DataFrame, models: list[Model]) -> DataFrame:
    """row, lang_pred, score: a pass over the texts for each model, of which tasks hold one at a time.  numbered: row, text."""
    passes = []
    for model in models:
        sent = numbered.sparkSession.sparkContext.broadcast(model)

        def run(batches, sent=sent):
            for b in _slices(batches):
                langs, _, top, mass = scores(sent.value, [t or "" for t in b.column("text").to_pylist()])
                yield batch_of(_SCORED, row=b.column("row"), lang=langs, top=top, mass=mass)

        passes.append(written(numbered.mapInArrow(task("language-id", run), "row long, lang string, top double, mass double"), "language-pass"))
        sent.destroy()
    every = functools.reduce(DataFrame.unionByName, passes).groupBy("row")
    best = every.agg(F.min(F.struct((-F.col("top")).alias("cost"), "lang")).alias("best"), F.collect_list(F.struct("top", "mass")).alias("all"))  # a struct for each model
    mass = F.aggregate("all", F.lit(0.0), lambda sum_, x: sum_ + x["mass"] * F.exp(x["top"] + F.col("best.cost")))
    lang = F.col("best.lang")
    return best.select("row", lang.alias("lang_pred"), F.when(lang == UNDETERMINED, 0.0).otherwise(1 / mass).alias("score"))


def identify(docs: DataFrame, models: list[Model]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    if not models:
        return slim.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    if len(models) > 1:
        numbered = written(slim.withColumn("row", F.monotonically_increasing_id()), "numbered")
        return numbered.select("row", "doc_id", "held_out").join(_by_passes(numbered.select("row", "text"), models), "row").drop("row")
    sent = docs.sparkSession.sparkContext.broadcast(models[0])

    def run(batches):
        for b in _slices(batches):
            langs, best, _, _ = scores(sent.value, [t or "" for t in b.column("text").to_pylist()])
            yield batch_of(_PREDICTED, doc_id=b.column("doc_id"), held_out=b.column("held_out"), lang_pred=langs, score=best)

    return slim.mapInArrow(task("language-id", run), "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs, ~held_out()))


def accepted_rows(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language is determined with at least this posterior."""
    models = train(docs, ~held_out())
    if not models:
        return docs.where("false")
    if len(models) > 1:
        numbered = written(docs.withColumn("_bw_row", F.monotonically_increasing_id()), "numbered")
        good = _by_passes(numbered.select(F.col("_bw_row").alias("row"), F.col("text").cast("string").alias("text")), models).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score))
        return numbered.join(good.select(F.col("row").alias("_bw_row")), "_bw_row", "left_semi").drop("_bw_row")
    sent = docs.sparkSession.sparkContext.broadcast(models[0])
    at = docs.columns.index("text")

    def run(batches):
        for b in _slices(batches):
            langs, best, _, _ = scores(sent.value, [t or "" for t in b.column(at).cast(pa.string()).to_pylist()])
            yield b.filter(pa.array([x != UNDETERMINED and s >= least_score for x, s in zip(langs, best)], type=pa.bool_()))

    return docs.mapInArrow(task("language-id", run), docs.schema)
