"""Filter audit, rank-array BPE and lexical search against plain Python and the tokenizers library, with odd inputs."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basewarp.llm import filter_audit, lexical_search, rank_array, wordbags
from basewarp.llm.common import IN_TOKEN, IN_WORD
from basewarp.llm.tokens import tokenizer_path

from .test_llm import LONG, ODD, PARTS, SCHEMA, SF, TOKENIZERS, low, words

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.selectExpr("*", "1 AS part", "2 AS mask", "'x' AS digest", "3 AS step", "4 AS block", "5 AS score", "6 AS rank", "7 AS query", "8 AS ids", "9 AS _id")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------------------- bags of words


@pytest.mark.parametrize("long", [8 << 20, 7])
def test_bags(monkeypatch, long):
    monkeypatch.setattr(wordbags, "LONG", long)
    for texts in (["a b a", "", "b  c\tb b"], ["one two one thirtyletterswithoutablankbetween two"], [""], ["   "]):
        data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
        bag = wordbags.bags(data, np.cumsum([0, *map(len, texts)]), IN_WORD)
        got = [Counter() for _ in texts]
        for t, w, n in zip(bag.text.tolist(), bag.term.tolist(), bag.count.tolist()):
            got[t][bag.terms[w].as_py().decode()] = n
        assert got == [Counter(t.split()) for t in texts]
        assert bag.n.tolist() == [len(t.split()) for t in texts]


# ---------------------------------------------------------------------------- filter audit


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    lowest = {}
    for i, text, _ in rows:
        if i is not None:
            lowest[text or ""] = min(i, lowest.get(text or "", i))
    failing = []
    for i, text, lang in rows:
        text = text or ""
        w = words(text)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and lowest[text] < i,
        }
        failing.append((lang or "", {k for k, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {x[0] for x in failing}:
        own = [x for x in failing if x[0] == part]
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                lost = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(lost)
                failed = sum(f in x[1] for x in own)
                out[part, order, step] = [len(left), len(lost), failed - len(lost), sum(x[1] == {f} for x in own), sum(x[2] for x in lost), sum(x[3] for x in lost)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_filter_audit(spark, odd, empty):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    want = brute_audit([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    got = filter_audit.filter_audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert audited(got) == want and len(want) == got.count()
    told = [(1, 1, 0), (2, 0, 1), (3, None, None), (5, 1, 1), (5, 0, 0), (None, 1, 1), (77, 1, 1)]
    assert audited(filter_audit.filter_audit(odd, spark.createDataFrame(told, LABELS))) == brute_audit([(r[0], r[1], r[2]) for r in ODD], told)
    assert filter_audit.filter_audit(empty, labels).count() == 0
    assert sum(x[4] + x[5] for x in audited(filter_audit.filter_audit(odd, spark.createDataFrame([], LABELS))).values()) == 0


def test_filter_audit_of_copies_without_ids_and_in_several_parts(spark):
    rows = [(None, "same", "en"), (None, "same", "fr"), (4, "same", "fr"), (4, "same", "de"), (5, "same", "en"), (None, None, None), (1, "", "x"), (9, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert audited(filter_audit.filter_audit(docs, spark.createDataFrame([], LABELS))) == brute_audit(rows, [])


def test_audit_of_other_filters(spark):
    cells = spark.createDataFrame([("p", 3, 5, 2, 1), ("p", 1, 2, 0, 0), ("p", 0, 7, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = audited(filter_audit.audit(cells, "XY"))
    assert got["p", "XY", 1] == (7, 7, 0, 2, 2, 1, 9) and got["p", "XY", 2] == (7, 0, 5, 0, 0, 0, 5)
    assert got["p", "YX", 1] == (9, 5, 0, 0, 2, 1, 5) and got["p", "YX", 2] == (7, 2, 5, 2, 0, 0, 9)
    with pytest.raises(ValueError):
        filter_audit.audit(cells, "XX")


# ---------------------------------------------------------------------------- rank arrays


@pytest.fixture(scope="module")
def codecs():
    from tokenizers import Tokenizer

    out = {}
    for name in TOKENIZERS:
        library = Tokenizer.from_file(tokenizer_path(name))
        library.no_truncation()
        library.no_padding()
        out[name] = rank_array.Codec(tokenizer_path(name)), library
    return out


def alike(codecs, name, texts):
    own, library = codecs[name]
    for at, ids, begins in own.encoded(pa.array(texts, type=pa.string())):
        numbers, digests = own.digests(ids, begins)
        for k, (a, z) in enumerate(zip(begins.tolist(), begins[1:].tolist())):
            want = library.encode(texts[at + k] or "", add_special_tokens=False).ids
            said = library.decode(want, skip_special_tokens=False)
            assert ids[a:z].tolist() == want, texts[at + k]
            assert own.decoded(ids[a:z]) == said
            assert numbers[k] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
            assert digests[k] == hashlib.sha256(said.encode()).hexdigest()


@pytest.mark.parametrize("name", TOKENIZERS)
def test_codec_equals_the_library(spark, codecs, name):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    alike(codecs, name, [*texts, *(r[1] for r in ODD), "ab" * 700 + "c", "x" * 257, "x" * 256, "é" * 300, "<|endoftext|> and <|startoftext|>"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), st.text(max_size=30)), max_size=6))
def test_codec_equals_the_library_on_any_text(codecs, texts):
    for name in TOKENIZERS:
        alike(codecs, name, texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcdeinrst", min_size=1, max_size=400), min_size=1, max_size=5))
def test_scanned_and_heaped_words_are_the_same(codecs, some):
    merges = codecs[TOKENIZERS[0]][0].merges
    data = np.frombuffer("".join(some).encode(), dtype=np.uint8)
    ids, n = merges.encode(data, np.cumsum([0, *map(len, some)]))
    ends = np.cumsum(n)
    for word, a, z in zip(some, ends - n, ends):
        parts = merges.inner[np.frombuffer(word.encode(), dtype=np.uint8)]
        parts[-1] = merges.last[ord(word[-1])]
        assert merges._heaped(parts).tolist() == ids[a:z].tolist()


def test_windows_of_ids(codecs, monkeypatch):
    monkeypatch.setattr(rank_array, "WINDOW", 3)
    for name in TOKENIZERS:
        alike(codecs, name, ["one two three four five", "", "x", LONG[:900]])


def test_encode_and_decode(spark, codecs, odd, empty):
    library = codecs[TOKENIZERS[0]][1] if TOKENIZERS[0].startswith("word") else codecs[TOKENIZERS[1]][1]
    want = sorted((str(r[0]), tuple(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in ODD)
    coded = rank_array.encode(odd)
    assert sorted((str(r["doc_id"]), tuple(r["ids"])) for r in coded.collect()) == want
    assert sorted((str(r["doc_id"]), r["text"]) for r in rank_array.decode(coded).collect()) == sorted((i, library.decode(list(x), skip_special_tokens=False)) for i, x in want)
    both = [(str(i), len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(library.decode(list(x), skip_special_tokens=False).encode()).hexdigest()) for i, x in want]
    assert sorted((str(r[0]), *r[1:]) for r in rank_array.round_trip(odd).collect()) == sorted(both)
    strange = spark.createDataFrame([(1, None), (2, [320, None, -5, 10**6]), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in rank_array.decode(strange).collect()} == {1: None, 2: library.decode([320], skip_special_tokens=False), 3: ""}
    assert [x.count() for x in (rank_array.encode(empty), rank_array.decode(rank_array.encode(empty)), rank_array.round_trip(empty))] == [0, 0, 0]


def test_unknown_files_are_errors(tmp_path):
    from tokenizers import Tokenizer, models

    Tokenizer(models.WordLevel({"a": 0}, unk_token="a")).save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        rank_array.Codec(str(tmp_path / "t.json"))


# ---------------------------------------------------------------------------- lexical search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(text or ""))


def brute_search(rows, items, k):
    counted = [(i, Counter(terms(t))) for i, t in rows]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    N, L = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c, n in counted:
            m = 50 + 50 * n * N // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(str(item), r, str(x[3]), -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((str(r["item_id"]), r["rank"], str(r["doc_id"]), r["score"]) for r in df.collect())


@pytest.mark.parametrize("block,first,group", [(1 << 20, 4, 1 << 20), (3000, 1, 300)])
def test_lexical_search(spark, monkeypatch, block, first, group):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical_search, "FIRST", first)
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", group * 20)
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = lexical_search.lexical_search(docs, items)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert found(got) == brute_search([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], 50)


def test_lexical_search_on_odd_tables(spark, odd, empty):
    asked = [(1, "one two SAME école"), (1, "lorem id"), (None, "no id here"), (2, None), (3, ""), (4, "?!"), (5, "absent"), (6, "ipsum ipsum 1234")]
    items = spark.createDataFrame(asked, "item_id long, text string").selectExpr("*", "1 AS query", "2 AS term")
    for k in (50, 2):
        assert found(lexical_search.lexical_search(odd, items, k)) == brute_search([(r[0], r[1]) for r in ODD], asked, k)
    assert lexical_search.lexical_search(empty, items).count() == 0
    assert lexical_search.lexical_search(odd, items.limit(0)).count() == 0


def test_lexical_search_prunes_blocks_and_keeps_ties(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCUMENTS", 8)
    rows = [(i, "needle " * (1 + i % 3) + "straw " * 20 if i % 40 == 0 else f"straw hay {i % 7}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "needle straw"), (2, "hay 3"), (3, "straw")], "item_id long, text string")
    assert found(lexical_search.lexical_search(docs, items, 10)) == brute_search(rows, [(1, "needle straw"), (2, "hay 3"), (3, "straw")], 10)


def test_bounds_are_never_below_a_score(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCUMENTS", 16)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    index = lexical_search.build_index(docs)
    text = "the of a and data model"
    vocabulary = pa.array(sorted(set(terms(text))))
    queries = lexical_search.Queries(vocabulary, np.arange(len(vocabulary)), np.array([0, len(vocabulary)]))
    weight = np.full(len(vocabulary), 1000, dtype=np.int64)
    bounds = lexical_search._bounds(index, queries, weight)
    scored = lexical_search._scored(index, queries, weight, bounds, 10**6, np.zeros(1, dtype=np.int64)).select("doc_id", "score")
    blocks = index.blocks.select("block", F.explode("doc_ids").alias("doc_id"))
    assert scored.count() > 50
    assert scored.join(blocks, "doc_id").join(bounds, "block").where("score > bound").count() == 0
    assert IN_TOKEN[ord("a")]


def test_index_files_have_few_blocks(spark, monkeypatch):
    """A task that reads or writes the index holds no more than a file's blocks, however many its partition has."""
    monkeypatch.setattr(lexical_search, "BLOCK_DOCUMENTS", 2)
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(400)], "doc_id long, text string").coalesce(1)
    index = lexical_search.build_index(docs)
    for table, most in ((index.blocks, lexical_search.FILE_BLOCKS), (index.heads, lexical_search.FILE_HEADS)):
        files = [r["n"] for r in table.groupBy(F.col("_metadata.file_path")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(files) == 200 and max(files) <= most
