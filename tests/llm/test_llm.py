"""The ten operators and the pipeline against plain Python, round trips and held-out accuracy, with odd inputs."""

import collections
import hashlib
import re
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basewarp.llm import components as cc
from basewarp.llm import exact_dedup, language_id, licenses, mixing, ngram_join, packing, pii, quality_rules, repair, toxicity
from basewarp.llm.perfect_hash import PerfectHash
from basewarp.llm.tokens import Encoder, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 8000
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "One two three four five six seven eight", "en", "a", 1),
    (5, "one two three four five six seven eight", "en", "b", 1),
    (5, "one two three four five six seven eight", "en", "b", 1),
    (6, "ÉCOLE école the same Same", "fr", None, 2),
    (7, LONG, "en", "", 3),
    (8, LONG + "end", "en", "b", 3),
    (None, "no id here, mail a.b@c.de now", "en", "b", 3),
    (9, "1234 !!! 5678", None, "c", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return {r["doc_id"]: r for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    # Extra columns whose names clash with those that operators make.
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.selectExpr("*", "1 AS kept", "2 AS n", "'x' AS root", "3 AS class", "4 AS size", "5 AS shard", "6 AS perm", "7 AS rank", "8 AS digest", "9 AS held_out")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return (text or "").encode().lower().decode()


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


# 1 language ID


def test_language_id(docs, plain, odd, empty, spark):
    got = language_id.language_id(docs).collect()
    assert len(got) == len(plain)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    right = [r["lang_pred"] == plain[r["doc_id"]]["lang"] for r in got if r["held_out"]]
    assert np.mean(right) > 0.95
    model = language_id.train(docs, ~language_id.held_out())
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (9, "und")} <= got
    assert len(language_id.identify(odd, model).collect()) == len(ODD)
    assert language_id.language_id(empty).count() == 0
    untrained = language_id.language_id(spark.createDataFrame([(1, "abc", None, None, 1)], SCHEMA)).collect()
    assert [r["lang_pred"] for r in untrained] == ["und"]


def test_language_scores_do_not_depend_on_batches(docs):
    model = language_id.train(docs, ~language_id.held_out())
    texts = [r["text"] for r in docs.limit(20).collect()] + [LONG]
    one = [language_id.scores(model[0], [t]) for t in texts]
    langs, best, _, _ = language_id.scores(model[0], texts)
    assert langs == [x[0][0] for x in one]
    assert np.allclose(best, [x[1][0] for x in one])


def hashed_gram(gram, bits):
    """chargrams' hash of one n-gram, in whole numbers."""
    h = ord(gram[0]) * 0x9E3779B1 & 0xFFFFFFFF
    for c in gram[1:]:
        h = (h ^ h >> 15 ^ ord(c)) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h >> 32 - bits


def gram_counts(text, orders, bits):
    s = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    return [collections.Counter(hashed_gram(s[i : i + k], bits) for i in range(len(s) - k + 1)) for k in orders]


def brute_language(rows):
    """Naive Bayes in dictionaries: (doc_id, text, lang) to doc_id -> (language, posterior)."""
    import math

    orders, bits = language_id.ORDERS, language_id.BITS
    learned, docs_of = {}, collections.Counter()
    for d, t, lang in rows:
        if d is not None and lang is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            docs_of[lang] += 1
            for mine, new in zip(learned.setdefault(lang, [collections.Counter() for _ in orders]), gram_counts(t, orders, bits)):
                mine.update(new)
    out = {}
    for d, t, _ in rows:
        if not docs_of or not any(c.isalpha() for c in t or ""):
            out[d] = ("und", 0.0)
            continue
        logs = {}
        for lang in sorted(docs_of):
            logs[lang] = math.log(docs_of[lang] / sum(docs_of.values()))
            for own, mine in zip(gram_counts(t, orders, bits), learned[lang]):
                total = sum(mine.values()) + language_id.SMOOTHING * 2**bits
                logs[lang] += sum(n * math.log((mine[b] + language_id.SMOOTHING) / total) for b, n in own.items())
        top = max(sorted(logs), key=logs.get)
        out[d] = (top, 1 / sum(math.exp(x - logs[top]) for x in logs.values()))
    return out


@pytest.mark.parametrize("most", [64, 2])
def test_language_id_against_brute_force(spark, docs, monkeypatch, most):
    rows = [(r["doc_id"], (r["text"] or "")[:300], r["lang"]) for r in docs.orderBy("doc_id").limit(50).collect()]
    rows += [(1000, None, "en"), (1001, "...", None), (1002, "the of and", None), (1003, "mixed der des les", "x-y")]
    df = spark.createDataFrame([(d, t, lang, "a", 1) for d, t, lang in rows], SCHEMA)
    monkeypatch.setattr(language_id, "MAX_LANGS", most)  # 2: several passes
    want = brute_language(rows)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(df).collect()}
    assert {d: x[0] for d, x in got.items()} == {d: x[0] for d, x in want.items()}
    assert all(abs(got[d][1] - want[d][1]) < 1e-6 for d in want)
    kept = {r["doc_id"] for r in language_id.accepted_rows(df).collect()}
    assert kept == {d for d, (lang, p) in want.items() if lang != "und" and p >= 0.5}


def test_long_texts_in_windows(monkeypatch):
    """Words, hashes and n-grams of long texts come in windows; what comes out is the same."""
    from basewarp.llm import chargrams, common

    text = "One two  thrée " * 400 + "x" * 3000 + " " * 700 + "end. " * 100
    data, offsets = np.frombuffer((text + "a b").encode(), dtype=np.uint8), np.array([0, len(text.encode()), len(text.encode()) + 3])
    whole = common.word_spans(data, offsets)
    hashes = common.word_hashes(data, *whole[:2])
    monkeypatch.setattr(common, "WINDOW", 64)
    parts = common.word_spans(data, offsets)
    assert all((x == y).all() for x, y in zip(whole, parts)) and len(whole[0]) == len(text.split()) + 2
    assert (common.word_hashes(data, *parts[:2]) == hashes).all() and len(set(hashes.tolist())) == 7
    total = [np.zeros(1 << 15, dtype=int) for _ in range(2)]
    for _, _, grams, which in chargrams.gram_runs([text], (2, 3), 100):
        for k in which:
            total[k] += np.bincount(grams.hashed((2, 3)[k], 15), minlength=(1 << 15) + 1)[: 1 << 15]
    for k, want in enumerate(gram_counts(text, (2, 3), 15)):
        assert {b: int(total[k][b]) for b in np.flatnonzero(total[k])} == dict(want)
    monkeypatch.setattr(chargrams.gram_runs, "__defaults__", (100,))
    short = [f.tolist() for f in toxicity.text_features(["ab cd", text, "é", text[:50], text])]
    monkeypatch.undo()
    assert [sorted(x) for x in short] == [sorted(f.tolist()) for f in toxicity.text_features(["ab cd", text, "é", text[:50], text])]


# 2 n-gram join


def brute_join(rows, k, percent):
    sets = []
    for _, text in rows:
        w = words(low(text))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in groups[root(i)] if rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    return sorted(out, key=str)


def near_copies(n=60, seed=5):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 120)]
    out = []
    for i in range(n):
        t = list(base)
        for j in rng.integers(0, len(t), rng.integers(0, 5)):
            t[j] = f"x{rng.integers(0, 10**6)}"
        out.append((100 + i, " ".join(t[: 120 - int(rng.integers(0, 12))])))
    return out


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, docs, plain, odd, empty, k, percent):
    got = sorted((tuple(r) for r in ngram_join.ngram_join(docs, k, percent).collect()), key=str)
    assert got == brute_join([(d, r["text"]) for d, r in plain.items()], k, percent)
    got = sorted((tuple(r) for r in ngram_join.ngram_join(odd, k, percent).collect()), key=str)
    assert got == brute_join([r[:2] for r in ODD], k, percent)
    assert ngram_join.ngram_join(empty, k, percent).count() == 0


def test_ngram_join_large_group_and_split_blocks(spark):
    rows = near_copies() + [(1, "a b c d e f g"), (2, "A B c d e f g"), (3, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_join(rows, 4, 85)
    assert sorted((tuple(r) for r in ngram_join.ngram_join(df).collect()), key=str) == want
    assert sorted((tuple(r) for r in ngram_join.ngram_join(df, block_sets=7).collect()), key=str) == want


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_shingles_common_over_many_batches_make_no_block(spark, monkeypatch, k, percent):
    """Each phrase is in 100 of 1,000 unlike texts, but in 2 of a batch's 20: a frequent shingle that no batch reports."""
    texts = []
    for i in range(1000):
        phrases = [" ".join(f"p{f}x{(i * (2 * f + 1) // 10 ** (f % 2) + f) % 10}y{j}" for j in range(5)) for f in range(6)]
        texts.append(" ".join(f"u{i}z{f}v{j} " + (p if j == 4 else "") for f, p in enumerate(phrases) for j in range(8)))
    blocks, kept = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: (out := kept(df, name), blocks.append(out) if name == "blocks" else None)[0])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        got = ngram_join.ngram_join(df, k, percent).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert all(r["doc_id"] == r["component_id"] for r in got) and len(got) == 1000
    assert blocks[0].count() == 0


def shuffle_files(spark):
    """Shuffle files that lie on this executor's disk."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_") and name.endswith(".data")}


def test_steps_leave_no_shuffle_files(spark, docs, monkeypatch):
    """Each step's shuffles go with the step: the disk never holds those of all steps together."""
    left, ordered, kept = [], ngram_join._ordered, ngram_join.written
    before = shuffle_files(spark)

    def settled(name):
        for _ in range(50):  # files are deleted in the background
            if not shuffle_files(spark) - before:
                break
            time.sleep(0.1)
        left.append((name, len(shuffle_files(spark) - before)))

    def watched(df, name):
        out = kept(df, name)
        settled(name)
        return out

    monkeypatch.setattr(ngram_join, "written", watched)
    monkeypatch.setattr(ngram_join, "_ordered", lambda *tables: (settled("order"), ordered(*tables))[1])
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    rows = ngram_join.kept_rows(docs, 5, 80)
    assert left == [(name, 0) for name in ("sets", "order", "blocks", "links")][: len(left)] and len(left) >= 3
    assert rows.count() and spark.conf.get(key) == was


def chained(plan):
    """Whether a Python node of the plan reads another one's rows without an exchange between them."""
    above = []
    for line in plan.splitlines():
        depth = re.search(r"[A-Za-z]|$", line).start()
        above = [x for x in above if x[0] < depth]
        if re.match(r"MapIn|FlatMapGroupsIn", line[depth:]):
            for _, node in reversed(above):
                if "Exchange" in node:
                    break
                if re.match(r"MapIn|FlatMapGroupsIn", node):
                    return True
        above.append((depth, line[depth:]))
    return False


def test_pipeline_keeps_few_python_workers(spark, docs, monkeypatch):
    """No task of the pipeline has two Python workers at once, and none has plain ones beside those for Arrow: they stay."""
    import corpus_pipeline as cp
    from basewarp.llm import common

    plans, kept = [], common.written

    def watched(df, *args, **named):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, *args, **named)

    for module in (language_id, exact_dedup, ngram_join, cc, mixing, packing, cp):
        monkeypatch.setattr(module, "written", watched)
    plans.append(cp.run(spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 20
    assert not any("ExistingRDD" in plan for plan in plans)
    assert not any(chained(plan) for plan in plans)


def test_language_scores_need_little_memory_beside_the_texts():
    import tracemalloc

    langs = [f"l{i}" for i in range(16)]
    rng = np.random.default_rng(3)
    tables = [np.vstack([rng.random(((1 << 15), 16)), np.zeros((1, 16))]) for _ in range(2)]
    texts = ["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(1000)]
    model = language_id.Model(langs, tables, np.zeros(16))
    language_id.scores(model, texts[:2])
    tracemalloc.start()
    try:
        language_id.scores(model, texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 32_000_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=12), min_size=2, max_size=12), st.sampled_from([60, 80, 85, 100]))
def test_divide_skip_spans_all_links(sets, percent):
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    forest = cc.Forest()
    for a, b in ngram_join.divide_skip(arrays, percent):
        assert 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
        forest.join(a, b)
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                assert forest.root(i) == forest.root(j)


def test_long_lists_over_batches():
    import pyarrow as pa

    token = np.repeat(np.arange(6), [2, 30, 1, 5, 60, 3]).astype(np.int64)
    key = np.concatenate([np.arange(n) for n in (2, 30, 1, 5, 60, 3)]).astype(np.int64)
    table = pa.table({"token": token, "class": key, "n": np.full(len(key), 10, dtype=np.int32), "hot": np.zeros(len(key), dtype=bool)})

    def edges(size):
        out = collections.Counter()
        for b in ngram_join._list_pairs(iter(table.to_batches(max_chunksize=size)), 85, short=24):
            out.update((r["a"], r["b"], r["n"]) for r in b.to_pylist())
        return out

    assert edges(7) == edges(1000) == edges(1)
    assert sum(edges(9).values()) == 1 + 30 + 10 + 60 + 3


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2)) if a != b] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, 2000 + k) for k in range(1, 200)]
    forest = cc.Forest()
    for a, b in pairs:
        forest.join(a, b)
    got = {r["node"]: r["root"] for r in cc.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: forest.root(x) for p in pairs for x in p}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_are_made_anew_when_two_sets_share_one(spark, monkeypatch):
    texts = [f"alpha beta gamma delta {k}" for k in range(6)] + ["alpha beta gamma delta 0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, ngram_join.ngram_join(df).collect()))
    clash = ngram_join._sets

    def clashing(batches, k, salt):
        import pyarrow as pa

        for b in clash(batches, k, salt):
            if salt == 0:
                key = pa.array([1 if x is not None and kind == 0 else x for x, kind in zip(b.column("key").to_pylist(), b.column("kind").to_pylist())], type=pa.int64())
                b = b.set_column(b.schema.get_field_index("key"), "key", key)
            yield b

    monkeypatch.setattr(ngram_join, "_sets", clashing)
    assert sorted(map(tuple, ngram_join.ngram_join(df).collect())) == want


# 3 exact dedup


def brute_dedup(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[low(t)].append(d)
    out = []
    for d, t in rows:
        ids = [x for x in groups[low(t)] if x is not None]
        keep = max(ids) if ids else None
        out.append((d, keep, len(groups[low(t)]), d == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup(docs, plain, odd, empty):
    assert sorted((tuple(r) for r in exact_dedup.exact_dedup(docs).collect()), key=str) == brute_dedup([(d, r["text"]) for d, r in plain.items()])
    assert sorted((tuple(r) for r in exact_dedup.exact_dedup(odd).collect()), key=str) == brute_dedup([r[:2] for r in ODD])
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({low(r["text"]) for r in plain.values()})


@settings(max_examples=30, deadline=None)
@given(st.sets(st.binary(min_size=32, max_size=32), max_size=300))
def test_perfect_hash(keys):
    keys = sorted(keys)
    m = np.frombuffer(b"".join(keys), dtype=np.uint8).reshape(-1, 32)
    assert sorted(PerfectHash(m).slots(m).tolist()) == list(range(len(keys)))


# 4 quality rules


def brute_quality(text):
    w = words(text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + d for places in at.values() if len(places) > 1 for i in places for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_rules(docs, plain, odd, empty):
    got = quality_rules.quality_rules(docs).collect()
    for r in got:
        assert tuple(r)[1:7] == brute_quality(plain[r["doc_id"]]["text"])
        assert not (r["base_failed"] and r["kept"])
    got = sorted((tuple(r)[:7] for r in quality_rules.quality_rules(odd).collect()), key=str)
    assert got == sorted(((r[0], *brute_quality(r[1])) for r in ODD), key=str)
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_are_planned_fast_below_a_filter_and_a_join(docs):
    began = time.time()
    judged = quality_rules.quality_rules(docs).where("kept AND n_words > 60").join(docs.select("doc_id", "text"), "doc_id").groupBy("n_words").count()
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert time.time() - began < 20  # minutes when the optimiser copies the measures into both
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_rules_follow_labels(spark):
    sf = "/root/testdata/sf0.01"
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [{"kept": r["kept"], "quality": quality[r["doc_id"]]} for r in quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r["doc_id"] in quality and not r["base_failed"]]
    assert np.mean([r["kept"] for r in got if r["quality"] == 1]) > 0.99
    assert np.mean([r["kept"] for r in got if r["quality"] == 0]) < 0.1


# 5 licenses


def license_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text))


def brute_license(text):
    w = license_words(text)
    places = [(i, label) for label, p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels = {label for _, label in places}
    more = set()
    for label, t in licenses.TEMPLATES:
        t = t.split()
        need = -(-licenses.THRESHOLD * len(set(t)) // 1)
        if any(len(set(t) & set(w[i : i + 2 * len(t)])) >= need for i in range(0, max(1, len(w)), len(t))):
            more.add(label)
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more))


def test_license_scan(spark, docs, plain, odd, empty):
    for df, rows in ((docs, [(d, r["text"]) for d, r in plain.items()]), (odd, [r[:2] for r in ODD])):
        got = sorted((tuple(r)[:7] for r in licenses.license_scan(df).collect()), key=str)
        assert got == sorted(((d, *brute_license(t)) for d, t in rows), key=str)
    assert licenses.license_scan(empty).count() == 0
    notices = [(i, "filler words here. " * 30 + t.upper().replace(" ", ",\n", 3) + " and more filler" * i) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    part = [(100 + i, " ".join(t.split()[: len(t.split()) // 3])) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    df = spark.createDataFrame(notices + part + [(200, "mit license mit license"), (201, "mit\n\nlicense")], "doc_id long, text string")
    got = sorted((tuple(r)[:7] for r in licenses.license_scan(df).collect()), key=str)
    assert got == sorted(((d, *brute_license(t)) for d, t in notices + part + [(200, "mit license mit license"), (201, "mit\n\nlicense")]), key=str)
    by_id = {r[0]: r for r in got}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in by_id[i][6].split(",")


def test_license_blocks_have_places(spark, docs):
    i, (label, text) = next((i, x) for i, x in enumerate(licenses.TEMPLATES))
    df = spark.createDataFrame([(1, "filler words here. " * 30 + text + " and more"), (2, "an MIT license"), (3, None)], "doc_id long, text string")
    got = licenses.license_blocks(df).collect()
    n = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text)))
    assert any(r["doc_id"] == 1 and r["label"] == label and not r["is_phrase"] and r["first_word"] <= 90 and 90 + n - 1 <= r["last_word"] and r["containment"] == 1 for r in got)
    assert [tuple(r) for r in got if r["doc_id"] == 2] == [(2, "mit", True, 1, 2, 1.0)]
    blocks = collections.defaultdict(set)
    for r in licenses.license_blocks(docs).collect():
        blocks[r["doc_id"]].add(r["label"])
    assert all(set(filter(None, r["labels"].split(","))) == blocks[r["doc_id"]] for r in licenses.license_scan(docs).collect())


# 6 PII

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1.-@_% +é", max_size=30))
def test_emails_as_the_expression(text):
    assert pii.emails(text) == [m.span() for m in EMAIL.finditer(text)]


def brute_pii(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[ -]", "", m.group())]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.findall("[0-9]", m.group())) <= 15]
    return sorted(out)


def said(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in spans)


def test_pii(docs, plain, odd, empty):
    for df, texts in ((docs, {d: r["text"] for d, r in plain.items()}), (odd, {r[0]: r[1] for r in ODD})):
        rows = pii.pii(df).collect()
        for r in rows:
            want = brute_pii(texts[r["doc_id"]])
            assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[1] == k for s in want) for k in range(4)]
            assert r["n_spans"] == len([x for x in r["spans"].split(",") if x])
            assert r["base_sha256"] == hashlib.sha256(said(want).encode()).hexdigest()
            assert set(said(want).split(",")) <= set(r["spans"].split(","))
    assert pii.pii(empty).count() == 0


def test_pii_learns_contexts(spark):
    seeds = [(i, f"Filler {i} text. Please call hotline +1 (300) 555-{1000 + i} for help number {i}.") for i in range(6)]
    seeds += [(10, "Another text. Please call hotline 0800-7711-22 for help."), (11, "Nothing to see in room 445566 today."), (12, "In room 123456 and room 654321.")]
    got = {r["doc_id"]: r["spans"] for r in pii.pii(spark.createDataFrame(seeds, "doc_id long, text string")).collect()}
    at = seeds[6][1].index("0800")
    assert got[10] == f"phone:{at}:{at + 12}"
    assert got[11] == got[12] == ""


def test_pii_learns_numbers_in_groups(spark):
    seeds = [(i, f"Filler {i} text. Please call hotline +1 (300) 555-{1000 + i} for help number {i}.") for i in range(30)]
    numbers = ["0800 7711 22", "(555) 123-4567", "4111 1111 1111 1112", "0800.7711 - 22", "[030] 1234 56", "0800-7711-23"]
    texts = [(100 + i, f"Another text. Please call hotline {n} for help.") for i, n in enumerate(numbers)]
    texts += [(200, "Another text. Please call hotline (0800 7711 24) for help."), (201, "In room 12 34 56 and room 4321 8765."), (202, "Please call hotline 12 34 for help.")]
    texts += [(203, "Please call hotline 1234 5678, 99 times. Please call hotline " + "12 " * 5000)]
    got = {r["doc_id"]: r["spans"] for r in pii.pii(spark.createDataFrame(seeds + texts, "doc_id long, text string")).collect()}
    for (i, t), n in zip(texts, [*numbers, "0800 7711 24"]):
        assert got[i] == f"phone:{t.index(n)}:{t.index(n) + len(n)}"
    assert got[201] == got[202] == ""
    at = texts[-1][1].index("12 12")
    assert got[203].startswith(f"phone:20:29,phone:{at}:{at + 26},")  # at most 19 digits: nine groups


def test_pii_found_instances_support_patterns(spark):
    seeds = [(i, f"Please call hotline +1 (300) 555-{1000 + i} for help.") for i in range(60)]
    found = [(100 + i, f"Please call hotline 0800-77{10 + i} for help. Or reach desk under 0800-77{10 + i} at night.") for i in range(15)]
    second = [(200, "Or reach desk under 0900-8822 at night."), (201, "The invoice number 0900-8833 was paid.")]
    docs = spark.createDataFrame(seeds + found + second, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.pii(docs).collect()}
    assert got[100].count("phone") == 2
    assert got[200] == "phone:20:29" and got[201] == ""


def brute_learned(texts, rounds=pii.ROUNDS, support=pii.SUPPORT, least=pii.LEAST_SCORE):
    """The pattern-instance graph in dictionaries: instance -> (kind, score) of what is accepted."""
    edges, seeds = collections.defaultdict(lambda: True), {}
    for t in texts:
        sure, likely = pii.secrets(t)
        sure = sorted(pii.base_spans(t) + sure)
        seen = [(a, z, False, k) for a, k, z in sure] + [(a, z, False, -1) for a, _, z in likely] + [(a, z, part, -1) for a, z, _, part in pii.candidates(t, sorted(sure + likely))]
        for a, z, part, k in seen:
            for p in pii._patterns(t, a, z):
                edges[p, t[a:z]] &= part
                if k >= 0:
                    seeds.setdefault(t[a:z], set()).add(k)
    seeds = {i: k for i, k in seeds.items()}
    known = {(i, k): 1.0 for i, ks in seeds.items() for k in ks}
    for _ in range(rounds):
        of = collections.defaultdict(list)
        for (p, i), part in edges.items():
            if not part:
                of[p].append(i)
        confidence = {}
        for p, own in of.items():
            for k in range(len(pii.KINDS)):
                scores = [known[i, k] for i in own if (i, k) in known]
                if sum(x >= least for x in scores) >= support:
                    confidence[p, k] = min(0.999, sum(scores) / len(own))
        known = {(i, k): 1.0 for i, ks in seeds.items() for k in ks}
        rest = collections.defaultdict(lambda: 1.0)
        for p, i in edges:
            for k in range(len(pii.KINDS)):
                if i not in seeds and (p, k) in confidence:
                    rest[i, k] *= 1 - confidence[p, k]
        known.update({x: 1 - r for x, r in rest.items()})
    best = {}
    for (i, k), score in sorted(known.items(), key=lambda x: x[0][1]):
        if i not in seeds and score >= least and (i not in best or score > best[i][1] + 1e-12):
            best[i] = (k, score)
    return best


def test_pii_graph_against_brute_force(spark):
    rng = np.random.default_rng(5)
    contexts = ["call hotline {} for", "visa number {} was", "room {} on", "my token = \"{}\" is", "mail {} now"]
    things = ["+1 (300) 555-{:04d}", "4111 1111 1111 1111", "{:06d}", "0800-77{:04d}", "zq{:04d}xy{:04d}", "u{:03d}@x.example.com", "1a2b3c4d5e6f7a8b9c0d1e2f{:04d}"]
    texts = []
    for _ in range(250):
        parts = [contexts[rng.integers(5)].format(things[rng.integers(7)].format(*rng.integers(0, 40, 2))) for _ in range(rng.integers(1, 4))]
        texts.append("so " + " and ".join(parts))
    found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").mapInArrow(pii._finder(pii.SEED_SWITCHES), pii._FOUND_SQL)
    got = {r["instance"]: (r["kind"], r["score"]) for r in pii.learned(found).collect()}
    want = brute_learned(texts)
    assert want and got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)


def test_pii_finds_planted_secrets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    planted = {d: [m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "")] for d, t in texts.items()}
    decoys = {d: [m.span() for m in re.finditer(r"(?<![0-9])[0-9]{16}(?![0-9])", t or "") if not pii._luhn(m.group())] for d, t in texts.items()}
    hit = false = 0
    for r in pii.pii(docs).collect():
        spans = set(r["spans"].split(","))
        hit += sum(f"secret:{a}:{z}" in spans for a, z in planted[r["doc_id"]])
        false += sum(any(x.endswith(f":{a}:{z}") for x in spans) for a, z in decoys[r["doc_id"]])
    assert hit == sum(map(len, planted.values())) > 100 and false == 0


def test_pii_contexts_find_what_no_seed_rule_names(spark):
    """Half of the planted tokens as seeds, and no rule for the others: the graph has to find them, and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    planted = {(d, *m.span(1)) for d, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "", re.I)}
    seeds = {(d, a, z) for d, t in texts.items() for a, _, z in pii.secrets(t or "", 20)[0]}
    assert seeds < planted and 0.3 < len(seeds) / len(planted) < 0.6
    base = {(d, a, z) for d, t in texts.items() for a, _, z in pii.base_spans(t or "")}
    rows = pii.pii(docs, 20, by_rule=False).collect()
    spans = {(r["doc_id"], int(a), int(z)) for r in rows for _, a, z in (x.split(":") for x in r["spans"].split(",") if x)}
    found = spans - base - seeds
    assert sum(r["n_learned"] for r in rows) == len(found)
    assert len(found & planted) >= 0.9 * len(planted - seeds) and len(found - planted) <= 0.02 * len(found)
    assert sum(r["n_learned"] for r in pii.pii(docs).collect()) > 30  # with the seeds that the query has


def test_pii_secret_contexts_and_shapes(spark):
    rng = np.random.default_rng(1)
    seeds = [(i, f"w{i} my token = \"{rng.bytes(16).hex()}\" here") for i in range(20)]
    more = [(100, 'see my token = "Zx81-kq" here'), (101, "see my token = 99887766 here"), (102, "key ghp_" + "a1B2" * 9 + " end"), (103, "id: a-very-long-slug-of-2020-10-12-words"), (104, 'x="' + "ab" * 20 + '"')]
    got = {r["doc_id"]: r["spans"] for r in pii.pii(spark.createDataFrame(seeds + more, "doc_id long, text string")).collect()}
    assert got[100] == "secret:16:23" and got[101] == "secret:15:23" and got[102] == "secret:4:44"
    assert got[103] == got[104] == ""


def test_pii_time_grows_with_the_text():
    import time

    began = time.time()
    assert pii.base_spans("1" * 1_000_000) == [] and pii.base_spans("1." * 500_000)
    assert time.time() - began < 3


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="017 ab.-()[]+@,\n", max_size=40))
def test_pii_numbers_keep_single_runs(text):
    spans = pii.base_spans(text)
    got = pii.candidates(text, spans)
    runs = [(m.start() + len(m.group()) - len(m.group().lstrip(".-()[]+@,")), m.start() + len(m.group().rstrip(".-()[]+@,"))) for m in re.finditer(r"\S*[0-9@]\S*", text)]
    runs = [(a, z) for a, z in runs if z - a >= 6 and not any(s < z and a < e for s, _, e in spans)]
    assert all(any(a <= lo and hi <= z for a, z, _, _ in got) for lo, hi in runs)
    assert all("\n" not in text[a:z] and not any(s < z and a < e for s, _, e in spans) for a, z, _, _ in got)


# 7 token ids


TOKENIZERS = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PARTS = [*"abcXYZ éßİıſ'’.,!?#$ \n\t\r\x0b\x0c\x1c\x85\xa0\u2003\u3000\u200b\u0301\u0307\u093e中文한\u1112\u1161각ЖжΣςÅẞ１½²٣\0\U0001f600ﬁ", "<|endoftext|>", "<|startoftext|>", "<|", "it's", "l'école", "  ", "\n\n", " a"]


@pytest.fixture(scope="module")
def encoders():
    from tokenizers import Tokenizer

    return {n: (Tokenizer.from_file(tokenizer_path(n)), Encoder(tokenizer_path(n)), Encoder(tokenizer_path(n), keep=20, slice_bytes=64)) for n in TOKENIZERS}


def encoded_alike(encoders, name, texts):
    library, *own = encoders[name]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    return all([x.tolist() for x in enc.encode(texts)] == want for enc in own)


@pytest.mark.parametrize("name", TOKENIZERS)
def test_encoder_equals_the_library(encoders, plain, name):
    texts = [r["text"] for r in plain.values()] + ["", " ", "\n", "  a b", "a  b", "a\n\n b\tc ", "it's 3.5, don't.", "<|endoftext|> x", "é\u0301 ok", "İ ΣΑΣ ς", "中İ?", "x y z", "a.\0b c", "foo.\nBar!!\n\nqux", "x_y. a_. 2a."]
    assert encoded_alike(encoders, name, texts) and encoded_alike(encoders, name, texts[::-1])
    assert encoded_alike(encoders, name, ["one two three " * 900 + "<|endoftext|>" + " é four" * 700, "x" * 3000, " " * 500, "中" * 400])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), st.text(max_size=30)), max_size=6))
def test_encoder_equals_the_library_on_any_text(encoders, texts):
    texts = [t.encode(errors="replace").decode() for t in texts]
    assert all(encoded_alike(encoders, n, texts) for n in TOKENIZERS)


def test_encoder_of_an_unknown_kind(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(tokenizer_path(TOKENIZERS[1])))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec))
    enc, library = Encoder(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    texts = ["", "one two", "it's\n <|endoftext|>x "]
    assert enc.kind is None and [x.tolist() for x in enc.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_ids(docs, plain, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in repair.read_file(repair.write_file(docs, shard_docs=60)).collect()}
    start = 0
    for d in sorted(plain):
        ids = np.array(tok.encode(plain[d]["text"], add_special_tokens=False).ids + [1], dtype="<u4")
        assert tuple(got[d]) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    rows = repair.token_ids(odd).collect()
    assert len(rows) == len(ODD)
    assert sorted(r["start"] for r in rows) == np.cumsum([0] + [r["n_tokens"] for r in sorted(rows, key=lambda r: r["start"])])[:-1].tolist()
    assert repair.token_ids(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=40), min_size=1, max_size=8), st.data())
def test_repair_round_trip(lists, data):
    ids = [np.array(x, dtype=np.uint16) for x in lists]
    rec = repair.Record(repair.record(0, list(range(len(ids))), ids, 6) | {})
    whole = np.concatenate([np.append(x, repair.END_ID) for x in ids])
    assert rec.all_ids().tolist() == whole.tolist()
    for k, x in enumerate(ids):
        assert rec.document(k).tolist() == [*x.tolist(), repair.END_ID]
    lo = data.draw(st.integers(0, len(whole)))
    hi = data.draw(st.integers(lo, len(whole)))
    assert rec.ids(lo, hi).tolist() == whole[lo:hi].tolist()


def test_repair_compresses():
    seq = np.tile(np.arange(9), 500)
    rules, out = repair.compress(seq, 12, 11)
    assert len(out) + 2 * len(rules) < len(seq) / 20


def test_repair_leaves_no_pair_twice_and_outgrows_16_bits():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 60_000, 6) for _ in range(9_000)]
    seq = np.concatenate([words[i] for i in rng.integers(0, 9_000, 40_000)])
    rules, out = repair.compress(seq, 60_001, 60_000)
    assert 60_001 + len(rules) > 1 << 16
    pairs = collections.Counter(zip(out[:-1].tolist(), out[1:].tolist()))
    assert all(n == 1 or a == b for (a, b), n in pairs.items())
    ids = [seq[:5000], seq[5000:]]
    rec = repair.Record(repair.record(0, [1, 2], ids, 60_000))
    assert rec.document(1).tolist() == [*ids[1].tolist(), repair.END_ID] and rec.document(0).tolist() == [*ids[0].tolist(), repair.END_ID]


# 8 toxicity


def test_toxicity(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] for r in got if r["toxic"] == 1]) > 0.85
    assert np.mean([r["predicted"] for r in got if r["toxic"] == 0]) < 0.03
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert toxicity.score(odd, model).count() == len(ODD)
    assert toxicity.toxicity(empty, labels.limit(0)).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).count() == len(ODD)


def test_toxicity_against_brute_force(spark, docs):
    """Log-count ratios, the classifier's fit and every score with dictionaries and dense tables."""
    import math

    rows = [(r["doc_id"], (r["text"] or "")[:200]) for r in docs.orderBy("doc_id").limit(50).collect()]
    rows = [(d, t + (" you awful stupid clown" if k % 3 == 0 else " a fine day")) for k, (d, t) in enumerate(rows)] + [(5000, None), (5001, "")]
    marks = {d: int(k % 3 == 0) for k, (d, _) in enumerate(rows[:50])}
    df = spark.createDataFrame([(d, t, None, None, 1) for d, t in rows], SCHEMA)
    labels = spark.createDataFrame([(d, x) for d, x in marks.items()], "doc_id long, toxic int")
    has = {d: {(k, b) for k, c in enumerate(gram_counts(t, toxicity.ORDERS, toxicity.BITS)) for b in c} for d, t in rows}
    train = [d for d in marks if zlib.crc32(str(d).encode()) % 5 != 0]
    n = [sum(marks[d] == x for d in train) for x in (0, 1)]
    ratio = {}
    for f in set().union(*(has[d] for d in train)):
        c = [toxicity.SMOOTHING + sum(f in has[d] for d in train if marks[d] == x) for x in (0, 1)]
        r = math.log(c[1] / (n[1] + 2 * toxicity.SMOOTHING)) - math.log(c[0] / (n[0] + 2 * toxicity.SMOOTHING))
        if abs(r) >= toxicity.LEAST_RATIO and abs(r) >= toxicity.LEAST_SIGMAS * math.sqrt(1 / c[0] + 1 / c[1]):
            ratio[f] = r
    used = sorted(ratio)
    assert used
    x = np.array([[ratio[f] if f in has[d] else 0.0 for f in used] for d in train])
    y = np.array([marks[d] for d in train], dtype=float)
    weight = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    w, b, m, v = np.full(len(used), 0.1), 0.0, 0.0, 0.0
    for t in range(1, toxicity.STEPS + 1):
        error = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        g = np.append(x.T @ error + toxicity.DECAY * w / len(used) * 10, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = toxicity.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(df, labels).collect()}
    for d, _ in rows:
        want = 1 / (1 + math.exp(-(sum(w[used.index(f)] * ratio[f] for f in has[d] if f in ratio) + b)))
        assert abs(got[d] - want) < 1e-4


# 9 mixing


def water_level(sizes, weights, most=3.0):
    """Targets by bisection: the level at which min(most * size, level * weight) adds up to all words."""
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most * s, mid * w) for s, w in zip(sizes, weights)) < sum(sizes) else (lo, mid)
    return [min(most * s, lo * w) for s, w in zip(sizes, weights)]


def test_targets(spark):
    def targets(sizes):
        df = spark.createDataFrame([(f"s{k:04d}", s, 1) for k, s in enumerate(sizes)], "source string, source_size long, rows long")
        return [r["target"] for r in mixing.with_targets(df).orderBy("source").collect()]

    assert targets([100, 100, 100]) == [187.5, 75, 37.5]
    assert targets([10, 100, 100]) == [30, 120, 60]
    assert targets([0, 10]) == [0, 10] and targets([0]) == [0] and targets([]) == []
    sizes = np.random.default_rng(1).integers(0, 5_000, 300).tolist() + [200_000]
    assert np.allclose(targets(sizes), water_level(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))]))


def test_mixing_with_many_sources_and_no_broadcast(spark, monkeypatch):
    rows = [(k, "w " * (1 + k % 23), None if k % 50 == 0 else f"http://s{k % 700}", "x") for k in range(4_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    plan = {r["doc_id"]: tuple(r) for r in mixing.mix(df, out_shards=7, block_rows=3).collect()}
    monkeypatch.setattr(mixing, "SENT", 10)
    assert {r["doc_id"]: tuple(r) for r in mixing.mix(df, out_shards=7, block_rows=3).collect()} == plan
    by = collections.defaultdict(list)
    for k, text, source, _ in rows:
        by[source].append(k)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, water_level([sum(1 + k % 23 for k in by[s]) for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    for s in names:
        taken = sum(plan[k][4] for k in by[s])
        assert abs(plan[by[s][0]][3] - want[s]) < 1e-3 and abs(taken - want[s]) <= 23
        assert all(plan[k][4] == plan[k][1] * plan[k][5] == plan[k][1] * len(plan[k][6] or []) for k in by[s])
    load = collections.Counter(x for p in plan.values() for x in p[6] or [])
    assert set(load) <= set(range(7)) and max(load.values()) < 2 * min(load.values())


def test_group_draws_add_up():
    frame = pd.DataFrame({"source": ["a", None, "c"], "quota": [10, 0, 90], "place": [0, 2, 1], "bunch": 3, "drawn": [[40, 0, 60]] * 3})
    got = mixing._deal(frame, 1)
    ends = np.stack(got["ends"])
    assert dict(zip(got["source"], ends[:, -1])) == {"a": 10, None: 0, "c": 90}
    assert np.diff(ends.sum(axis=0), prepend=0).tolist() == [40, 0, 60] and (np.diff(ends, axis=1) >= 0).all()


def test_split_is_exact():
    q = np.array([100, 7, 0, 33])
    held = mixing.split(q, 5, 1)
    assert (held.sum(axis=0) == q).all()
    assert held.sum(axis=1).max() - held.sum(axis=1).min() <= 3


def test_mixing(docs, plain, odd, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(plain)
    by = collections.defaultdict(list)
    for r in rows:
        assert r["size"] == len(words(plain[r["doc_id"]]["text"]))
        assert r["taken"] == r["size"] * r["copies"] and r["copies"] <= 3
        by[plain[r["doc_id"]]["source"]].append(r)
    names = sorted(by)
    want = water_level([sum(r["size"] for r in by[s]) for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, t in zip(names, want):
        assert abs(by[s][0]["target"] - t) < 1e-6
        assert abs(sum(r["taken"] for r in by[s]) - t) <= max(0.05 * t, max(r["size"] for r in by[s]) / 2)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert len(mixing.mix(odd).collect()) == len(ODD)
    assert mixing.mix(empty).count() == 0
    taken = {r["doc_id"]: r["copies"] for r in rows if r["copies"]}
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in out.collect()) == taken


def test_row_filters_keep_clashing_columns(odd, empty):
    for df in (odd.withColumns({"place": F.lit(1), "shards": F.lit(2), "copies": F.lit(3), "source_size": F.lit(4), "component_id": F.lit(5), "keep_id": F.lit(6)}), empty):
        for f in (exact_dedup.kept_rows, mixing.mixed_rows, lambda d: ngram_join.kept_rows(d, 5, 80), language_id.accepted_rows):
            out = f(df)
            assert out.columns == df.columns and out.count() <= 3 * df.count()


def test_ngram_links_are_all_there(spark):
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base[: 60 - k % 3] + [f"end{k}"]) for k in range(12)] + ["alone in the world of texts", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    want = {i: sum(100 * len(x & y) >= 85 * len(x | y) for y in sets if x and y and x != y) for i, x in enumerate(sets)}
    assert min(want[i] for i in range(12)) == 11  # a spanning tree has 11 links in all, these are 66
    for block_sets in (4096, 5):
        assert {r["doc_id"]: r["n_links"] for r in ngram_join.link_counts(df, block_sets=block_sets).collect()} == want


def test_row_filters_judge_rows_and_not_ids(spark):
    story = " ".join(f"word{k}" for k in range(40))
    rows = [(1, "one text", "a"), (None, "One text", "a"), (None, "a text of its own", "a"), (None, None, "a"), (2, "first of two", "a"), (2, "one TEXT", "a"), (3, "one text", "b")]
    got = exact_dedup.kept_rows(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([rows[2], rows[3], rows[4], rows[6]], key=str)
    rows = [(1, story, "a"), (None, story + " end", "a"), (None, "a text of its own and nothing else", "a"), (None, "", "a"), (2, story + " End.", "a"), (2, "some other words are in this one", "a"), (7, story.replace("word", "x"), "a"), (7, story.replace("word", "x") + " end", "a")]
    got = ngram_join.kept_rows(spark.createDataFrame(rows, "doc_id long, text string, source string"), 5, 80).collect()
    assert set(map(tuple, got)) - set(rows[6:]) == {rows[0], rows[2], rows[3], rows[5]} and len(got) == 5
    rows = [(k % 7 or None, f"text {k % 20} " * (1 + k % 9), "abc"[k % 3]) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix(df).collect()
    out = collections.Counter(map(tuple, mixing.mixed_rows(df).collect()))
    assert set(out) <= set(rows) and sum(out.values()) == sum(r["copies"] for r in plan)
    assert sum(len(words(t)) * n for (_, t, _), n in out.items()) == sum(r["taken"] for r in plan)


def test_mixing_small_blocks(docs):
    rows = mixing.mix(docs, out_shards=5, block_rows=3).collect()
    assert {s for r in rows for s in r["shards"] or []} <= set(range(5))
    for r in rows:
        assert len(r["shards"] or []) == r["copies"]


# 10 packing


def test_packing(docs, plain, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(plain)
    for d, own in by_doc.items():
        ids = np.array(tok.encode(plain[d]["text"], add_special_tokens=False).ids + [0], dtype="<u4")
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 2048)))
        at = 0
        for k, r in enumerate(own):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert k == 0 or r["length"] == 2048
            at += r["length"]
        assert at == len(ids)
    total = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total += at
    best = {seq + k // per for _, _, m, per, seq, _ in plan(collections.Counter(r["length"] for r in rows)) for k in range(m)}
    assert total / 2048 <= len(by_seq) <= 1.001 * len(best) + 1
    assert len({r["doc_id"] for r in packing.pack(odd).collect()}) == len({r[0] for r in ODD})
    assert packing.pack(empty).count() == 0


def plan(counts: dict[int, int], capacity: int = 2048) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, pieces a sequence, first sequence, offset) that pack counts[length] pieces of each length.

    Rank first + k goes to sequence first sequence + k // per, at offset + length * (k % per).
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    opened, out = 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        for gap in sorted(g for g in gaps if g >= length):
            per = gap // length
            rest: list[tuple[int, int]] = []
            for at, (lo, hi) in enumerate(gaps[gap]):
                if not left:
                    rest += gaps[gap][at:]
                    break
                filled = min(hi - lo, left // per)
                if filled:
                    out.append((length, rank, filled * per, per, lo, capacity - gap))
                    gaps.setdefault(gap - per * length, []).append((lo, lo + filled))
                    rank, left = rank + filled * per, left - filled * per
                if left and lo + filled < hi:  # the last, partly filled one
                    out.append((length, rank, left, left, lo + filled, capacity - gap))
                    gaps.setdefault(gap - left * length, []).append((lo + filled, lo + filled + 1))
                    rank, left, filled = rank + left, 0, filled + 1
                if lo + filled < hi:
                    rest.append((lo + filled, hi))
            gaps[gap] = rest
            if not rest:
                del gaps[gap]
            if not left:
                break
        if left:
            per = capacity // length
            full, odd = divmod(left, per)
            if full:
                out.append((length, rank, full * per, per, opened, 0))
                gaps.setdefault(capacity - per * length, []).append((opened, opened + full))
                opened, rank = opened + full, rank + full * per
            if odd:
                out.append((length, rank, odd, odd, opened, 0))
                gaps.setdefault(capacity - odd * length, []).append((opened, opened + 1))
                opened += 1
        gaps.pop(0, None)
        for gap, held in gaps.items():  # join neighbouring intervals again
            if len(held) > 1:
                held.sort()
                merged = [held[0]]
                for lo, hi in held[1:]:
                    if merged[-1][1] == lo:
                        merged[-1] = (merged[-1][0], hi)
                    else:
                        merged.append((lo, hi))
                gaps[gap] = merged
    return out


def sequences_of(placed, sizes, capacity):
    """Checks that all pieces lie gapless in sequences, each once; how many sequences there are."""
    assert sorted(r["number"] for r in placed) == sorted(sizes)
    by_seq = collections.defaultdict(list)
    for r in placed:
        by_seq[r["sequence"]].append((r["offset"], sizes[r["number"]]))
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


@pytest.mark.parametrize("kind", ["spread", "equal", "small", "large"])
def test_place_in_distributed_supersteps(spark, kind):
    rng = np.random.default_rng(3)
    n = 3_000
    size = {"spread": rng.integers(1, 2048, n), "equal": np.full(n, 700), "small": rng.integers(1, 30, n), "large": rng.integers(1100, 2048, n)}[kind]
    sizes = dict(enumerate(size.tolist()))
    df = spark.createDataFrame(list(sizes.items()), "number long, size int")
    best = {seq + k // per for _, _, m, per, seq, _ in plan(collections.Counter(sizes.values())) for k in range(m)}
    for rows in (150, 10_000):
        got = sequences_of(packing.place(spark, df, 2048, rows).collect(), sizes, 2048)
        assert got <= 1.002 * len(best) + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 15), min_size=1, max_size=60), st.integers(1, 8))
def test_supersteps_over_ranges(sizes, parts):
    """Sweeps of several ranges and the deal over their edges, without Spark: no gap is claimed twice and all fit."""
    gaps = [(16, True, k) for k in range(-(-sum(sizes) // 16))]
    state = sorted([(s, False, k) for k, s in enumerate(sizes)] + gaps)
    cut = [state[len(state) * i // parts : len(state) * (i + 1) // parts] for i in range(parts)]
    said, counts = {}, []
    for i, own in enumerate(cut):
        sweep = packing.Sweep(16)
        said[i] = list(sweep.rows([x[2] for x in own], [x[0] for x in own], [x[1] for x in own])) + list(sweep.rest())
        waits, free = ([x[2] for x in said[i] if x[0] == kind] for kind in (1, 2))
        counts.append((i, len(waits), max(waits, default=0), len(free), min(free, default=0)))
    runs = packing.deal(np.array(counts))
    waits = {(i, x[5]): x for i in said for x in said[i] if x[0] == 1}
    free = {(i, x[5]): x[2] for i in said for x in said[i] if x[0] == 2}
    used = collections.Counter()
    for part, first, n, each, to, gap in runs.tolist():
        for k in range(n):
            used[to, gap + k // each] += waits.pop((part, first + k))[2]
    assert all(used[g] <= free[g] for g in used)
    # No waiting piece is left below a free gap.
    rest = [free[g] for g in free if not used[g]]
    assert not waits or not rest or min(x[2] for x in waits.values()) > 0 and all(min(p for p, _ in waits) >= g[0] for g in free if not used[g])


# pipeline


def test_pipeline(spark, docs, plain):
    import corpus_pipeline as cp

    now, by_stage = docs, {}
    for name, stage in cp.STAGES:
        now = stage(spark, now, SF)
        by_stage[name] = now = spark.createDataFrame(now.collect(), now.schema)
    ids = {n: [r["doc_id"] for r in df.collect()] for n, df in by_stage.items()}
    lettered = [d for d, r in plain.items() if re.search(r"[^\W\d_]", r["text"])]
    assert sorted(ids["language_id"]) == sorted(lettered)
    kept = [d for d, keep, *_ in brute_dedup([(d, plain[d]["text"]) for d in lettered]) if d == keep]
    assert sorted(ids["exact_dedup"]) == sorted(kept)
    near = [d for d, _, c in brute_join([(d, plain[d]["text"]) for d in kept], 5, 80) if d == c]
    assert sorted(ids["ngram_join"]) == sorted(near)
    assert set(ids["mixing"]) <= set(near) and max(collections.Counter(ids["mixing"]).values()) <= 3
    assert set(ids["packing"]) == set(ids["mixing"])
    for n in ("language_id", "exact_dedup", "ngram_join", "mixing"):
        assert by_stage[n].columns == docs.columns
    assert cp.run(spark, SF).count() == by_stage["packing"].count()


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty):
    import corpus_pipeline as cp

    for df in (odd, empty):
        now = df
        for name, stage in cp.STAGES:
            columns = now.columns
            now = stage(spark, now, SF)
            now = spark.createDataFrame(now.collect(), now.schema)
            assert name == "packing" or now.columns == columns
        assert now.count() >= 0 and {"doc_id", "piece", "sequence_id"} <= set(now.columns)
    assert now.count() == 0


def test_registered_queries():
    from basewarp.llm import queries

    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 11)] == [1] * 10
