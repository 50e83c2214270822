"""N-gram Jaccard join by T-occurrence search (DivideSkip), split for Spark.

Sets are the distinct word shingles of a text as 64-bit hashes.  Texts with equal sets form
a class (64 bits of the sorted set's 128-bit digest; should two sets share them, all are made
anew with another salt); the join is over classes.

1. Global order: all but frequent shingles come in hash order, then the frequent ones, the most frequent last.
   Shingles frequent within any batch are summed over all tasks (the ``FREQUENT`` most frequent count);
   by the order that these give, the shingles that step 2 may take are counted over all classes, so
   what is rare in every batch and yet in more than ``SHORT`` classes is frequent, too (``COUNTED`` at most).
2. Short lists: with T = the overlap that any partner needs and K = min(``EXTRA``, T), a
   class puts its first ``n - T + K`` shingles into the inverted index; two linked classes
   share at least the lesser K of these.  A list of at most ``SHORT`` classes gives its pairs
   that lengths allow; pairs are counted and those with K or more are candidates.  The classes
   of a longer list, or of a frequent shingle, belong to one block.
3. Blocks are the components of candidates and stars.  Each class's whole set goes to its
   block once.  In a block DivideSkip runs as published: of a set's T-occurrence lists the L
   longest are set aside, the others heap-merged, and what occurs T - L times is probed
   by binary search for the long ones; exact counts decide links.  Classes already
   connected are not compared again, so ngram_join has only components; ``links`` with
   ``every_link`` and ``link_counts`` skip nothing and have all links.  A block beyond ``BLOCK_SETS`` or ``BLOCK_ITEMS`` is dealt
   to all pairs of its sub-blocks, so a task's memory is bounded and no pair is lost.
4. Components of the links give the result.

Nothing is capped: lists, candidates, partners and texts are whole.

Defined results: empty or null text has no shingles and is linked with nothing; a text of
fewer words than a shingle has its whole word sequence as one; rows without doc_id take
part, but a component's id is its least known doc_id; repeated rows share class and
component; an empty table gives an empty result; columns besides doc_id and text are not
read.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, chunks, dropped, id_and_text, mixed, row_keys, shuffles_dropped, task, word_hashes, word_spans, written
from .components import Forest, components

WORDS, PERCENT = 4, 85
#: Shingles kept as frequent (a bound of what is broadcast; it only shapes the order) and how often one is in a batch to be reported.
FREQUENT, REPORTED = 1 << 17, 4
#: Shingles kept as frequent once they are counted over all classes (broadcast, and it only shapes the order, too).
COUNTED = 1 << 20
#: Lists up to this length give pairs, longer ones (and those of shingles counted more often than HOT) stars.
SHORT, HOT = 64, 256
#: K, the shared short lists that make a candidate.
EXTRA = 4
#: Sets and set items of a block that one task takes.
BLOCK_SETS, BLOCK_ITEMS = 4096, 4_000_000
#: Classes of many copies whose one representative is known to all tasks (a bound of what is broadcast).
CROWDS = 1 << 16
_BITMAP = 23

_U = np.uint64
_MULT = np.random.default_rng(2).integers(1, 1 << 63, 16, dtype=np.uint64) * _U(2) + _U(1)


def least_overlap(n, percent: int):
    """What a set of n items must share with any partner."""
    return -(-percent * n // 100)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    starts, ends, first = word_spans(data, offsets)
    w = word_hashes(data, starts, ends)
    if len(w) >= k:
        h = w[: len(w) - k + 1] * _MULT[0]
        for j in range(1, k):
            h = h + w[j : len(w) - k + 1 + j] * _MULT[j]
        h = mixed(h)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= k:
            u = np.sort(h[lo : hi - k + 1])
            out.append(u[np.concatenate([[True], u[1:] != u[:-1]])])
        elif hi > lo:  # marked by its length, so it equals no longer shingle
            whole = np.append(w[lo:hi] * _MULT[: hi - lo], _MULT[15 - (hi - lo)])
            out.append(mixed(whole.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def class_of(u: np.ndarray, salt: int = 0) -> int:
    return digest_of(u, salt)[0]


def digest_of(u: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """A set's 128-bit digest: the class, and what tells whether another set has the same class."""
    raw = hashlib.blake2b(u.tobytes(), digest_size=16, salt=salt.to_bytes(4, "little")).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


class Order:
    """The global order: frequent shingles (sorted hashes and ranks, 0 the most frequent) come after all others."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        rank = np.empty(len(hashes), dtype=np.int64)
        rank[np.lexsort((hashes, -counts))] = np.arange(len(hashes))
        by = np.argsort(hashes)
        self.hashes, self.rank, self.hot = hashes[by], rank[by], int((counts > HOT).sum())
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(hashes >> _U(42)).astype(np.int64)] = True

    def first(self, u: np.ndarray, n: int) -> tuple[np.ndarray, int]:
        """The first n items of a sorted set in this order, and how many of them are not hot."""
        at = np.flatnonzero(self.maybe[(u >> _U(42)).astype(np.int64)])
        if len(at):
            where = np.minimum(np.searchsorted(self.hashes, u[at]), len(self.hashes) - 1)
            same = self.hashes[where] == u[at]
            at, where = at[same], where[same]
        if not len(at):
            return u[:n], min(n, len(u))
        rare = np.ones(len(u), dtype=bool)
        rare[at] = False
        plain = u[rare][:n]
        if len(plain) == n:
            return plain, n
        late = np.argsort(-self.rank[where])[: n - len(plain)]
        return np.concatenate([plain, u[at[late]]]), n - int((self.rank[where[late]] < self.hot).sum())


def _ordered(reported: pa.Table, common: pa.Table) -> Order:
    """Of both tables' shingles (those reported by batches, those counted over all classes), each with its greater count."""
    token, place = np.unique(np.concatenate([reported.column("key").to_numpy(), common.column("token").to_numpy()]), return_inverse=True)
    count = np.zeros(len(token), dtype=np.int64)
    np.maximum.at(count, place, np.concatenate([reported.column("n").to_numpy(), common.column("n").to_numpy()]))
    return Order(token.view(np.uint64), count)


_SETS = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("key", pa.int64()), ("check", pa.int64()), ("n", pa.int64())])
_COUNTS = pa.schema([("token", pa.int64()), ("n", pa.int64())])
_POSTINGS = pa.schema([("token", pa.int64()), ("class", pa.int64()), ("n", pa.int32()), ("hot", pa.bool_())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("need", pa.int32())])
_ARRAYS = pa.schema([("class", pa.int64()), ("items", pa.binary())])


def _sets(batches, k: int, salt: int):
    """Rows of kind 0: a document's class and set size; kind 1: a shingle frequent in the batch and its count."""
    for b in batches:
        ids, row_keys_ = b.column("doc_id"), b.column("_bw_key")
        once: dict[int, np.ndarray] = {}  # copies count once
        for at, data, offsets in chunks(b.column("text")):
            sets = shingle_sets(data, offsets, k)
            n = np.array([len(u) for u in sets], dtype=np.int64)
            both = np.array([digest_of(u, salt) if len(u) else (0, 0) for u in sets], dtype=np.int64).reshape(-1, 2)
            keys = both[:, 0]
            yield batch_of(_SETS, kind=np.zeros(len(sets), dtype=np.int8), doc_id=ids.slice(at, len(sets)), row_key=row_keys_.slice(at, len(sets)), key=pa.array(keys, mask=n == 0), check=both[:, 1], n=n)
            once.update(zip(keys.tolist(), sets))
        every = np.concatenate(list(once.values())) if once else np.zeros(0, dtype=np.uint64)
        once.clear()
        every.sort()
        # An item that is there REPORTED times equals the one REPORTED - 1 places on.
        ahead = every[REPORTED - 1 :]
        often = np.unique(ahead[every[: len(ahead)] == ahead])
        count = np.searchsorted(every, often, side="right") - np.searchsorted(every, often, side="left")
        m = len(often)
        yield batch_of(_SETS, kind=np.ones(m, dtype=np.int8), doc_id=pa.nulls(m, pa.int64()), row_key=pa.nulls(m, pa.int64()), key=often.view(np.int64), check=pa.nulls(m, pa.int64()), n=count)


def _crowded(crowds: dict[int, int], key: int, doc) -> bool:
    """Whether the document is one of many copies and not the one that stands for them."""
    return crowds.get(key, doc) != doc


def _reach(batches, k: int, percent: int, order: Order, crowds: dict[int, int], salt: int):
    """The shingles that classes may put into the inverted index, and how many classes of the batch: those that they put
    there in this order, and half as many again for what another order moves back."""
    for b in batches:
        ids = b.column("doc_id").to_pylist()
        some: list[np.ndarray] = []
        done: set[int] = set()
        for at, data, offsets in chunks(b.column("text")):
            own = []
            for doc, u in zip(ids[at:], shingle_sets(data, offsets, k)):
                n = len(u)
                if not n:
                    continue
                key = class_of(u, salt)
                if key in done or _crowded(crowds, key, doc):
                    continue
                done.add(key)
                t = least_overlap(n, percent)
                own.append(order.first(u, min(n, 3 * (n - t + min(EXTRA, t)) // 2))[0])
            if own:
                some.append(np.concatenate(own))
        if some:
            token, count = np.unique(np.concatenate(some), return_counts=True)
            yield batch_of(_COUNTS, token=token.view(np.int64), n=count)


def _postings(batches, k: int, percent: int, order: Order, crowds: dict[int, int], salt: int):
    for b in batches:
        ids = b.column("doc_id").to_pylist()
        for at, data, offsets in chunks(b.column("text")):
            tokens, keys, sizes, lens, hot = [], [], [], [], []
            done: set[int] = set()
            for doc, u in zip(ids[at:], shingle_sets(data, offsets, k)):
                n = len(u)
                if not n:
                    continue
                key = class_of(u, salt)
                if key in done or _crowded(crowds, key, doc):
                    continue
                done.add(key)
                t = least_overlap(n, percent)
                own, plain = order.first(u, n - t + min(EXTRA, t))
                tokens.append(own)
                flag = np.ones(len(own), dtype=bool)
                flag[:plain] = False
                hot.append(flag)
                keys.append(key)
                sizes.append(n)
                lens.append(len(own))
            if tokens:
                yield batch_of(_POSTINGS, token=np.concatenate(tokens).view(np.int64), **{"class": np.repeat(np.array(keys, dtype=np.int64), lens)}, n=np.repeat(np.array(sizes, dtype=np.int32), lens), hot=np.concatenate(hot))


def _list_pairs(batches, percent: int, short: int = SHORT):
    """Postings sorted by shingle to edges: a short list's pairs that lengths allow count 1 each; the classes of a long
    list, or of a frequent shingle, get an edge to a node that stands for the shingle."""
    empty = np.zeros(0, dtype=np.int64)
    held, long_token = (empty, empty, empty), None

    def star(token, key):
        return token, key, np.full(len(key), EXTRA), np.ones(len(key), dtype=np.int64)

    def lists(token, key, n, last: bool) -> list[tuple]:
        nonlocal held, long_token
        out: list[tuple] = []
        if not len(token):
            return out
        if long_token is not None:
            goes_on = token == long_token
            out.append(star(token[goes_on], key[goes_on]))
            token, key, n = token[~goes_on], key[~goes_on], n[~goes_on]
        if not len(token):
            return out
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])])
        token, key, n = token[new], key[new], n[new]
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(edge, len(token)))
        long_token = None
        if not last:  # the last list may go on in the next batch
            if size[-1] <= short:
                held = (token[edge[-1] :], key[edge[-1] :], n[edge[-1] :])
                edge, size = edge[:-1], size[:-1]
            else:
                long_token = token[-1]
        for lo, m in zip(edge[size > short].tolist(), size[size > short].tolist()):
            out.append(star(token[lo : lo + m], key[lo : lo + m]))
        for m in range(2, short + 1):  # all lists of one length at once
            rows = edge[size == m][:, None] + np.arange(m)
            for i, j in itertools.combinations(range(m), 2) if len(rows) else ():
                x, y = rows[:, i], rows[:, j]
                small, large = np.minimum(n[x], n[y]).astype(np.int64), np.maximum(n[x], n[y]).astype(np.int64)
                ok = 100 * small >= percent * large
                x, y, small = x[ok], y[ok], small[ok]
                out.append((np.minimum(key[x], key[y]), np.maximum(key[x], key[y]), np.ones(len(x), dtype=np.int64), np.minimum(EXTRA, least_overlap(small, percent))))
        return out

    def rows(parts: list[tuple]):
        a, b, n, need = (np.concatenate(x) for x in zip(*parts))
        for lo in range(0, len(a), 50_000):
            yield batch_of(_PAIRS, a=a[lo : lo + 50_000], b=b[lo : lo + 50_000], n=n[lo : lo + 50_000].astype(np.int32), need=need[lo : lo + 50_000].astype(np.int32))

    for batch in batches:
        token, key, n = (batch.column(c).to_numpy() for c in ("token", "class", "n"))
        hot = batch.column("hot").to_numpy(zero_copy_only=False)
        parts = [star(token[hot], key[hot])] if hot.any() else []
        got = [np.concatenate([h, g[~hot]]) for h, g in zip(held, (token, key, n))]
        held = (empty, empty, empty)
        parts += lists(*got, last=False)
        if parts:
            yield from rows(parts)
    parts = lists(*held, last=True)
    if parts:
        yield from rows(parts)


def _arrays(batches, k: int, bits: np.ndarray, crowds: dict[int, int], salt: int):
    """Whole sets of the classes that some block has (the bitmap lets a few others through)."""
    for b in batches:
        ids = b.column("doc_id").to_pylist()
        for at, data, offsets in chunks(b.column("text")):
            keys, items = [], []
            for doc, u in zip(ids[at:], shingle_sets(data, offsets, k)):
                if len(u):
                    key = class_of(u, salt)
                    bit = key & (1 << _BITMAP) - 1
                    if int(bits[bit >> 6]) >> (bit & 63) & 1 and not _crowded(crowds, key, doc):
                        keys.append(key)
                        items.append(u.tobytes())
            yield batch_of(_ARRAYS, **{"class": keys}, items=items)


def divide_skip(sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None, every_link: bool = False) -> list[tuple[int, int]]:
    """Links that span the components of the sets (sorted distinct items): T-occurrence search for each set in turn.

    sides: if given, only sets of different sides are compared.  every_link: all links, also of sets already connected.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    by = np.argsort(size, kind="stable")  # partners of a set are those after it, up to 100 / percent times its size
    sets, size = [sets[i] for i in by], size[by]
    side = None if sides is None else np.asarray(sides)[by]
    every, item = np.unique(np.concatenate(sets), return_inverse=True)
    doc = np.repeat(np.arange(len(sets)), size)
    key = np.argsort(item, kind="stable")
    posting, frequency = doc[key], np.bincount(item, minlength=len(every))
    at = np.append(0, np.cumsum(frequency))
    cut = np.append(0, np.cumsum(size))
    group = np.arange(len(sets))  # component of each set
    members = {i: [i] for i in range(len(sets))}
    links: list[tuple[int, int]] = []

    def join(r: int, s: int) -> None:
        links.append((int(by[r]), int(by[s])))
        if every_link:
            return  # each set stays a component of its own, so nothing is skipped
        x, y = int(group[r]), int(group[s])
        if len(members[x]) < len(members[y]):
            x, y = y, x
        group[members[y]] = x
        members[x] += members.pop(y)

    for r in range(len(sets) - 1):
        n = int(size[r])
        last = int(np.searchsorted(size, 100 * n // percent, side="right"))
        if last <= r + 1 or not (group[r + 1 : last] != group[r]).any():
            continue
        t = -(-percent * 2 * n // (100 + percent))  # partners are no smaller
        own = item[cut[r] : cut[r + 1]]
        order = own[np.argsort(-frequency[own], kind="stable")]
        longest = int(frequency[order[0]])
        skip = min(t - 1, max(0, int(t / (0.01 * np.log2(longest + 1) + 1))))  # L of the paper
        far, near = order[:skip], order[skip:]
        near = near[frequency[near] > 1]
        lists = []
        for x in near.tolist():
            p = posting[at[x] : at[x + 1]]
            p = p[np.searchsorted(p, r, side="right") : np.searchsorted(p, last)]
            p = p[group[p] != group[r]]
            if len(p):
                lists.append(p)
        if len(lists) < t - skip:
            continue
        merged = [(s, sum(1 for _ in same)) for s, same in itertools.groupby(heapq.merge(*(p.tolist() for p in lists)))]
        far = np.sort(far)
        for s, count in merged:
            if count < t - skip or group[s] == group[r] or side is not None and side[s] == side[r]:
                continue
            other = item[cut[s] : cut[s + 1]]
            if len(far):
                count += int((other[np.minimum(np.searchsorted(other, far), len(other) - 1)] == far).sum())  # binary probes
            if 100 * count >= percent * (n + int(size[s]) - count):
                join(r, s)
    return links


def _link_block(frame: pd.DataFrame, percent: int, every_link: bool) -> pd.DataFrame:
    frame = frame.drop_duplicates("class")
    keys = frame["class"].to_numpy(np.int64)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in frame["items"]]
    two = frame["i"].iloc[0] != frame["j"].iloc[0]
    links = divide_skip(sets, percent, frame["own"].to_numpy() if two else None, every_link) if len(sets) > 1 else []
    return pd.DataFrame({"a": keys[[x for x, _ in links]], "b": keys[[y for _, y in links]]}, dtype=np.int64)


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """2**_BITMAP bits, those of all nodes set; at most 2**(_BITMAP - 6) words come to the driver."""
    bit = F.col("node").bitwiseAND(F.lit((1 << _BITMAP) - 1))
    with shuffles_dropped(nodes.sparkSession):
        words = nodes.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST((node & {(1 << _BITMAP) - 1}) & 63 AS INT))")).alias("v")).collect()
    out = np.zeros(1 << (_BITMAP - 6), dtype=np.uint64)
    for r in words:
        out[r["w"]] = r["v"] & (1 << 64) - 1
    return out


def links(docs: DataFrame, words: int, percent: int, block_sets: int, block_items: int, every_link: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sets: doc_id, row_key, class, n; component roots of linked classes: class, root; with every_link all links of classes instead: a, b)."""
    spark = docs.sparkSession
    slim = id_and_text(docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_keys("text")[1])
    for salt in itertools.count():
        both = written(keyed.mapInArrow(task("ngram-join", lambda bs, salt=salt: _sets(bs, words, salt)), "kind tinyint, doc_id long, row_key long, key long, check long, n long"), "sets")
        sets = both.where("kind = 0").select("doc_id", "row_key", F.col("key").alias("class"), "n")
        with shuffles_dropped(spark):
            unlike = both.where("kind = 0 AND key IS NOT NULL").groupBy("key").agg((F.min("check") < F.max("check")).alias("clash")).where("clash").isEmpty()
        if unlike:
            break
        dropped(both)  # two sets with one class: all classes anew
    with shuffles_dropped(spark):
        top = both.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
        crowd = sets.where("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("d")).where("c >= 8").orderBy(F.desc("c"), "class").limit(CROWDS).toArrow()
    reported = spark.sparkContext.broadcast(Order(top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()))
    crowds = spark.sparkContext.broadcast(dict(zip(crowd.column("class").to_pylist(), crowd.column("d").to_pylist())))

    reach = slim.mapInArrow(task("ngram-join", lambda bs: _reach(bs, words, percent, reported.value, crowds.value, salt)), "token long, n long")
    with shuffles_dropped(spark):  # as large as the postings' own
        common = reach.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > SHORT).orderBy(F.desc("n"), "token").limit(COUNTED).toArrow()
    order = spark.sparkContext.broadcast(_ordered(top, common))

    postings = slim.mapInArrow(task("ngram-join", lambda bs: _postings(bs, words, percent, order.value, crowds.value, salt)), "token long, class long, n int, hot boolean")
    # A frequent shingle's postings need not meet, so they are dealt by class.
    lists = postings.repartition("token", F.when(F.col("hot"), F.col("class"))).sortWithinPartitions("token", "class")
    pairs = lists.mapInArrow(task("ngram-join", lambda bs: _list_pairs(bs, percent)), "a long, b long, n int, need int")
    candidates = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need")).where("n >= need").select("a", "b")
    blocks = written(components(candidates), "blocks")

    # Sub-blocks: by the block's sets and items.
    classes = sets.where("class IS NOT NULL").groupBy("class").agg(F.max("n").alias("n"))
    within = blocks.join(classes, F.col("node") == F.col("class")).select("class", "root", "n")
    parts = within.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block_sets)), F.ceil(F.sum("n") / F.lit(block_items))).cast("int").alias("parts"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    within = within.join(parts, "root").select(F.col("class").alias("node"), "root", "parts")

    bits = spark.sparkContext.broadcast(_bitmap(blocks))
    arrays = slim.mapInArrow(task("ngram-join", lambda bs: _arrays(bs, words, bits.value, crowds.value, salt)), "class long, items binary")
    dealt = arrays.join(within, F.col("class") == F.col("node")).withColumn("own", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "items")
    found = dealt.groupBy("root", "i", "j").applyInPandas(lambda f: _link_block(f, percent, every_link), "a long, b long")
    if every_link:
        return sets, found
    # Written first: a task that both links blocks and contracts edges has two Python workers, which then stay with the executor.
    return sets, components(written(found, "links")).withColumnRenamed("node", "class")


def _labelled(docs: DataFrame, words: int, percent: int, block_sets: int, block_items: int) -> DataFrame:
    """ngram_join's columns, the row's key and the root of its group (null without shingles)."""
    sets, roots = links(docs, words, percent, block_sets, block_items)
    least = sets.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("d"))
    labelled = least.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    best = labelled.groupBy("root").agg(F.min("d").alias("component_id"))
    by_class = labelled.join(best, "root").select("class", "root", "component_id")
    out = sets.join(by_class.hint("merge"), "class", "left")
    return out.select("row_key", "root", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block_sets: int = BLOCK_SETS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return _labelled(docs, words, percent, block_sets, block_items).drop("row_key", "root")


def link_counts(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block_sets: int = BLOCK_SETS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id and n_links of every row: the classes (texts of other shingle sets) that its own class is linked with."""
    sets, found = links(docs, words, percent, block_sets, block_items, every_link=True)
    n = found.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    return sets.join(n.hint("merge"), "class", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def kept_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row of each group of near copies, that of the least doc_id, with all columns.  If texts of one group share that
    doc_id (or none has one), those of one text stay."""
    labelled = _labelled(docs, words, percent, BLOCK_SETS, BLOCK_ITEMS)
    first = labelled.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # All rows of a group here have the same doc_id or none; texts without shingles are groups of their own.
    one = first.groupBy("root", F.when(F.col("root").isNull(), F.col("row_key")).alias("own"), "doc_id").agg(F.min("row_key").alias("_bw_key"))
    kept = one.select(F.coalesce("doc_id", F.lit(0)).alias("_bw_id"), "_bw_key").distinct()
    return docs.select("*", *row_keys("text")).join(kept, ["_bw_id", "_bw_key"], "left_semi").drop("_bw_id", "_bw_key")
