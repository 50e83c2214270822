"""Toxicity: a character n-gram linear classifier on features scaled by naive Bayes log-count ratios.

A feature is a hashed character n-gram that occurs in a text.  From labelled training rows,
at most ``SAMPLE`` a class (the smallest hashes of doc_id, a documented bound), Spark
counts in how many texts of either class each feature occurs; the log of the smoothed
ratio scales the feature, and a logistic regression is fitted on the scaled features whose
ratio is large and significant.  Every whole text is then scored.

Defined results: null text is empty and gets the intercept's score; rows with null toxic
or null doc_id never train; if either class has no training row the score is that class's
smoothed share; a doc_id that is labelled several times trains once with its largest
label; repeated documents are scored alike; columns besides doc_id and text are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chargrams import gram_runs
from .common import batch_of, id_and_text, task, written

ORDERS, BITS = (3, 4, 5), 18
#: Labelled rows a class that training uses at most.
SAMPLE = 3_000
#: A feature is used if its log ratio is at least LEAST_RATIO either way and LEAST_SIGMAS standard errors from 0.
SMOOTHING, LEAST_RATIO, LEAST_SIGMAS = 1.0, 0.7, 3.0
STEPS, RATE, DECAY = 150, 0.05, 1e-1

_WIDTH = (1 << BITS) + 1
_FEATURES = len(ORDERS) * _WIDTH
_COUNTS = pa.schema([("feature", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())])
_ROWS = pa.schema([("toxic", pa.int32()), ("features", pa.binary())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def text_features(texts: list[str]):
    """Per text its distinct features.  A scratch table of last places finds the first of equals without sorting."""
    scratch = np.zeros(_WIDTH, dtype=np.int32)
    long: dict[int, np.ndarray] = {}  # of a text in windows, which features it has
    for at, n, grams, which in gram_runs(texts, ORDERS):
        if len(which) < len(ORDERS):
            seen = long.setdefault(at, np.zeros(_FEATURES, dtype=bool))
            seen[which[0] * _WIDTH + grams.hashed(ORDERS[which[0]], BITS)] = True
            continue
        yield from _finished(long)
        hashed = [grams.hashed(order, BITS) for order in ORDERS]
        for i in range(n):
            lo, hi = grams.offsets[i], grams.offsets[i + 1]
            found = []
            for k, h in enumerate(hashed):
                own = h[lo:hi]
                place = np.arange(len(own), dtype=np.int32)
                scratch[own] = place
                own = own[scratch[own] == place]
                found.append(own[own < _WIDTH - 1] + np.int32(k * _WIDTH))
            yield np.concatenate(found)
    yield from _finished(long)


def _finished(long: dict[int, np.ndarray]):
    for at in sorted(long):
        seen = long.pop(at)
        seen[_WIDTH - 1 :: _WIDTH] = False  # no n-gram
        yield np.flatnonzero(seen).astype(np.int32)


class Model:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept


def _scores(model: Model, texts: list[str]) -> np.ndarray:
    total = np.array([model.weights[f].sum() for f in text_features(texts)], dtype=np.float64) + model.intercept
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64(F.lit(8), F.col("doc_id"))
    picked = rows.where("toxic = 1").orderBy(order, "doc_id").limit(SAMPLE).unionByName(rows.where("toxic = 0").orderBy(order, "doc_id").limit(SAMPLE))
    # At most 2 * SAMPLE ids are broadcast.
    sample = written(id_and_text(docs).join(F.broadcast(picked), "doc_id").select("toxic", "text").repartition(8), "toxic-sample")

    def count(batches):
        held = np.zeros((2, _FEATURES), dtype=np.int64)
        n = [0, 0]
        for b in batches:
            for toxic, f in zip(b.column("toxic").to_pylist(), text_features([t or "" for t in b.column("text").to_pylist()])):
                held[toxic][f] += 1
                n[toxic] += 1
        for toxic in (0, 1):
            at = np.flatnonzero(held[toxic])
            yield batch_of(_COUNTS, feature=np.append(at, -1).astype(np.int32), toxic=np.full(len(at) + 1, toxic, dtype=np.int32), n=np.append(held[toxic][at], n[toxic]))

    got = sample.mapInArrow(task("toxicity", count), "feature int, toxic int, n long").groupBy("feature", "toxic").agg(F.sum("n").alias("n")).toArrow()
    feature, toxic, n = (got.column(c).to_numpy() for c in ("feature", "toxic", "n"))
    size = [int(n[(feature == -1) & (toxic == k)].sum()) for k in (0, 1)]
    if not all(size):
        share = (size[1] + 1) / (sum(size) + 2)
        return Model(np.zeros(_FEATURES, dtype=np.float32), float(np.log(share / (1 - share))))
    counts = np.full((2, _FEATURES), SMOOTHING)
    here = feature >= 0
    counts[toxic[here], feature[here]] += n[here]
    ratio = np.log(counts[1] / (size[1] + 2 * SMOOTHING)) - np.log(counts[0] / (size[0] + 2 * SMOOTHING))
    error = np.sqrt(1 / counts[1] + 1 / counts[0])
    ratio[(np.abs(ratio) < LEAST_RATIO) | (np.abs(ratio) < LEAST_SIGMAS * error)] = 0
    used = np.flatnonzero(ratio)
    sent = spark.sparkContext.broadcast(ratio != 0)

    def featured(batches):
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield batch_of(_ROWS, toxic=b.column("toxic"), features=[f[sent.value[f]].astype(np.int32).tobytes() for f in text_features(texts)])

    data = sample.mapInArrow(task("toxicity", featured), "toxic int, features binary").toArrow()
    y = data.column("toxic").to_numpy().astype(np.float64)
    lists = [np.frombuffer(x, dtype=np.int32) for x in data.column("features").to_pylist()]
    number = np.zeros(_FEATURES, dtype=np.int32)
    number[used] = np.arange(len(used))
    lens = np.array([len(x) for x in lists])
    index = number[np.concatenate(lists)] if lens.sum() else np.zeros(0, dtype=np.int32)
    return Model(*_fit(index, lens, y, ratio[used], used))


def _fit(index: np.ndarray, lens: np.ndarray, y: np.ndarray, ratio: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with L2 decay by Adam over all rows; rows of either class weigh alike."""
    row = np.repeat(np.arange(len(y)), lens)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.full(len(ratio), 0.1), 0.0
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, STEPS + 1):
        z = np.bincount(row, weights=(w * ratio)[index], minlength=len(y)) + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        g = np.append(np.bincount(index, weights=error[row], minlength=len(ratio)) * ratio + DECAY * w / max(len(ratio), 1) * 10, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(_FEATURES, dtype=np.float32)
    weights[used] = w * ratio
    return weights, float(b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = _scores(sent.value, [t or "" for t in b.column("text").to_pylist()])
            yield batch_of(_SCORED, doc_id=b.column("doc_id"), held_out=b.column("held_out"), score=s, predicted=(s >= 0.5).astype(np.int32))

    return id_and_text(docs).withColumn("held_out", held_out()).mapInArrow(task("toxicity", run), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
