"""Sequences in parts, automata, ranks, stretches and carried edges, seeds with errors and many matrices, against plain Python."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basewarp.functions import sequence as sq
from basewarp.functions.sequence import iupac_regex
from basewarp.operators import automaton, derive, match, orfs, parts, proximity, scan, windows
from basewarp.plans import patterns as pt
from basewarp.plans.rules import parse_rule


def bases(n, seed, letters="acgt"):
    return "".join(random.Random(seed).choices(letters, k=n))


def whole(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")


def in_parts(spark, texts, size=37, seed=1):
    rng, rows = random.Random(seed), []
    for i, text in enumerate(texts):
        at = no = 0
        while at < len(text):
            n = rng.randint(0, size)
            rows.append((i, no * 3, text[at : at + n] or None))
            at, no = at + n, no + 1
    rng.shuffle(rows)
    return parts.join_parts(spark.createDataFrame(rows, "seq_id long, part_no long, seq string"))


# ---------------------------------------------------------------------------- parts


@pytest.mark.parametrize("run", [4096, 5])
def test_parts(spark, monkeypatch, run):
    monkeypatch.setattr(parts, "RUN", run)
    texts = [bases(300, 1), "a", bases(1000, 2, "acgtn")]
    df = in_parts(spark, texts)
    at = sorted((r["seq_id"], r["base"], r["seq_len"], r["bases"]) for r in df.collect())
    for i, text in enumerate(texts):
        own = [x for x in at if x[0] == i]
        assert "".join(x[3] for x in own) == text and {x[2] for x in own} == {len(text)}
        assert [x[1] for x in own] == [sum(len(y[3]) for y in own[:k]) for k in range(len(own))]
    for overlap, chunk, circular in ((0, 64, False), (9, 64, False), (100, 30, False), (9, 64, True)):
        got = {(r["seq_id"], r["base"]): tuple(r)[1:] for r in match.chunked(df, overlap, circular, chunk).collect()}
        assert got == {(r["seq_id"], r["base"]): tuple(r)[1:] for r in match.chunked(whole(spark, texts), overlap, circular, chunk).collect()}
    turned = sorted((r["seq_id"], r["base"], r["bases"]) for r in parts.twin(df).collect())
    assert ["".join(x[2] for x in turned if x[0] == i) for i in range(3)] == [sq.plain_reverse_complement(t) for t in texts]


def test_searches_take_parts(spark, monkeypatch):
    monkeypatch.setattr(match, "CHUNK", 100)
    texts = [bases(900, 3), bases(40, 4), "gaattc"]
    ps = [pt.pattern("E", "G'AATT_C"), pt.Pattern("e", "gatc", errors=1)]
    for search in (lambda s: match.find_sites(s, ps), lambda s: match.find_regex(s, [("r", "ga+(c|t)")]), lambda s: match.find_matrix(s, "m", [(5, 1, 1, 1), (1, 1, 5, 1), (1, 6, 1, 1)], 90), lambda s: match.nmer_counts(s, 3), lambda s: derive.degenerate_runs(s)):
        assert sorted(map(str, search(in_parts(spark, texts)).collect())) == sorted(map(str, search(whole(spark, texts)).collect()))


# ---------------------------------------------------------------------------- automata

EXPRESSIONS = ["ga+c", "ga(tt|ac)n{1,3}y", "wt{2,4}ar", "a*", "(ac)*g", "g.{2,}t", "[^a]c+?t", "(a|cg){2,3}t?", "a{0,2}", "(a(c|g)*t)+", "((ac)?g){1,3}$?"[:-2], "n"]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(EXPRESSIONS), st.lists(st.text(alphabet="aaccggttnr", max_size=60), min_size=1, max_size=5), st.data())
def test_automata_against_re(expression, texts, data):
    regex = iupac_regex(expression)
    machine = automaton.automaton(regex)
    plain = re.compile(regex)
    raw = automaton.CODE[np.frombuffer("".join(texts).encode(), dtype=np.uint8)]
    row, place = machine.starts(raw, np.cumsum([0, *map(len, texts)]), np.zeros(len(texts), dtype=np.int64))
    assert sorted(zip(row.tolist(), place.tolist())) == [(i, p) for i, t in enumerate(texts) for p in range(len(t)) if plain.match(t, p)]
    text = "".join(texts)
    cuts = sorted({0, len(text), *data.draw(st.lists(st.integers(0, len(text)), max_size=4))})
    state, found = 0, []
    for lo, hi in reversed(list(zip(cuts, cuts[1:]))):
        found += [lo + int(p) for p in machine.starts(raw[lo:hi], np.array([0, hi - lo]), np.array([state]))[1]]
        state = int(machine.leaves(raw[lo:hi])[state])
    assert sorted(found) == [p for p in range(len(text)) if plain.match(text, p)]


def test_expressions_without_automaton():
    assert [automaton.automaton(x) for x in ("a(?=c)", "^ac", "ac$", r"(a)\1", "gaga([acgt]{300,500})ttct", "a{9000}", "a(?P<x>c)")] == [None] * 7


@pytest.mark.parametrize("form", ["rows", "parts"])
def test_unbounded_expressions_over_chunks(spark, monkeypatch, form):
    monkeypatch.setattr(match, "CHUNK", 64)
    texts = ["c" + "a" * 300 + "c" + "g" + "a" * 200 + "c" + "t" * 50, bases(700, 5), "", "gac", "g" * 64 + "a" * 64 + "c" * 64]
    asked = [("run", "ga+c"), ("far", "ga.*cc"), ("any", "(ac)*t")]
    got = {tuple(r) for r in match.find_regex(whole(spark, texts) if form == "rows" else in_parts(spark, texts), asked).select("seq_id", "pat", "strand", "site").collect()}
    want = set()
    for i, text in enumerate(texts):
        for name, rx in asked:
            want |= {(i, name, 1, p + 1) for p in range(len(text)) if re.compile(rx).match(text, p)}
            want |= {(i, name, -1, len(text) - p) for p in range(len(text)) if re.compile(rx).match(sq.plain_reverse_complement(text), p)}
    assert got == want


def test_parts_need_an_automaton_for_unbounded_expressions(spark):
    with pytest.raises(ValueError):
        match.find_regex(in_parts(spark, ["acgt"]), [("x", "a+(?=c)")])


def test_expressions_take_linear_time(spark):
    took = []
    for n in (400_000, 1_600_000):
        df = whole(spark, [bases(n, 6)]).repartition(1)
        match.find_regex(df, [("x", "ga+c")]).count()
        began = time.time()
        assert match.find_regex(df, [("x", "ga+c")]).count() > n / 40
        took.append(time.time() - began)
    assert took[1] < 3 * took[0] + 5


# ---------------------------------------------------------------------------- errors and matrices


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="acgtrn", min_size=3, max_size=18), st.integers(0, 3)), min_size=1, max_size=6), st.lists(st.text(alphabet="acgtn", max_size=90), min_size=1, max_size=4), st.sampled_from([1 << 18, 50]))
def test_seeds_with_errors(patterns, texts, size):
    planted = [t + "".join(random.Random(len(t)).choice(sq.IUPAC[x]) for x in p) + t for t, (p, _) in zip(itertools.cycle(texts), patterns)]
    texts = [t for t in texts + planted if t] or ["a"]
    old, scan.SLICE = scan.SLICE, size
    try:
        sites = [scan.Site(p, min(e, len(p)), "plain") for p, e in patterns]
        column, own = pa.array(texts), np.array([len(t) for t in texts])
        want = {(k, int(r), int(s)) for k, rows, starts in scan.find(column, sites, own) for r, s in zip(rows, starts)}
        fit = lambda p, t, e: sum(not (x in "acgt" and x in sq.IUPAC[y]) for x, y in zip(t, p)) <= e and set(t) <= set("acgt")
        brute = {(k, i, s + 1) for k, (p, e) in enumerate(patterns) if e for i, t in enumerate(texts) for s in range(len(t) - len(p) + 1) if fit(p, t[s : s + len(p)], e)}
        assert {x for x in want if patterns[x[0]][1]} == brute
        able = [k for k, (p, e) in enumerate(patterns) if e and scan.error_seeds(p, e)]
        if able:
            keys = {}
            for number, k in enumerate(able):
                for at, word in scan.error_seeds(*patterns[k]):
                    for plain in sq.expand(word):
                        keys.setdefault(len(word), []).append((plain, number, at))
            got = [(able[j], int(r), int(s)) for js, rows, starts in scan.find_by_pieces(column, [sites[k] for k in able], [scan.SeedIndex(w, n) for n, w in keys.items()], own) for j, r, s in zip(js, rows, starts)]
            assert len(got) == len(set(got)) and set(got) == {x for x in brute if x[0] in able}
    finally:
        scan.SLICE = old


def test_many_patterns_with_errors_in_spark(spark):
    texts = [bases(3000, 7), bases(200, 8, "acgtn"), ""]
    ps = [pt.Pattern(f"p{k}", bases(8 + k % 9, 50 + k), errors=k % 3, top_cut=1) for k in range(12)]
    for circular in (False, True):
        one = {tuple(r) for r in match.find_sites(whole(spark, texts), ps, circular=circular, seeds=False).collect()}
        assert {tuple(r) for r in match.find_sites(whole(spark, texts), ps, circular=circular, seeds=True).collect()} == one


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 20)] * 4), min_size=1, max_size=9), st.integers(30, 100), st.text(alphabet="acgtn", max_size=80), st.sampled_from([1 << 18, 20]))
def test_matrices(counts, percent, text, size):
    if not any(map(sum, counts)):
        return
    rows, need = match.matrix_scores(counts, percent)
    old, scan.SLICE = scan.SLICE, size
    try:
        got = [(int(s), int(x)) for _, _, starts, scores in scan.find_matrices(pa.array([text, ""]), [scan.Matrix(rows, need)], np.array([len(text), 0])) for s, x in zip(starts, scores)]
    finally:
        scan.SLICE = old
    want = []
    for p in range(len(text) - len(rows) + 1):
        part = text[p : p + len(rows)]
        if "n" not in part and (score := sum(r["acgt".index(x)] for r, x in zip(rows, part))) >= need:
            want.append((p + 1, score))
    assert got == want


def test_matrices_keep_names_of_sequences(spark):
    df = spark.createDataFrame([("chr1", "ccagtcc"), (None, "ccactcc"), ("x", None)], "seq_id string, seq string")
    counts = [(10, 0, 0, 0), (0, 0, 10, 0), (0, 0, 0, 10)]
    got = {(r["seq_id"], r["pat"], r["strand"], r["start"]) for r in match.find_matrices(df, [("m", counts), ("none", [(0, 9, 0, 0)] * 5)], 100).collect()}
    assert got == {("chr1", "m", 1, 3), (None, "m", -1, 3)}


# ---------------------------------------------------------------------------- reading frames


@pytest.mark.parametrize("chunk", [3, 30, 3 << 15])
@pytest.mark.parametrize("require_met", [True, False])
def test_reading_frames_of_parts(spark, chunk, require_met):
    texts = [bases(1000, 9), bases(7, 10), "a", "acg" * 60, "atg" + "gca" * 90 + "taa" + bases(50, 11), bases(200, 12, "acgtn")]
    got = orfs.orfs(in_parts(spark, texts), 4, require_met=require_met, chunk=chunk)
    want = orfs.orfs(whole(spark, texts), 4, require_met=require_met)
    assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_frames_of_parts(spark):
    texts = [bases(100, 13), "acgtacgt", "ac"]
    rows = orfs.frame_parts(in_parts(spark, texts), chunk=30).collect()
    for r in orfs.frames(whole(spark, texts)).collect():
        own = sorted((x["aa_begin"], x["protein"]) for x in rows if (x["seq_id"], x["frame"]) == (r["seq_id"], r["frame"]))
        assert "".join(p for _, p in own) == r["protein"]
        assert [a for a, _ in own] == [1 + 10 * k for k in range(len(own))]
    with pytest.raises(ValueError):
        orfs.orfs(in_parts(spark, ["acgt"]), chunk=10)


# ---------------------------------------------------------------------------- ranks, stretches, edges


@pytest.fixture(scope="module")
def sites(spark):
    rng = random.Random(14)
    rows = {(i, n, p, rng.randint(1, n)) for i, n in ((0, 500), (1, 90), (2, 3000)) for p in "ABC" for _ in range(n // 20)} | {(3, 10, "A", 4), (4, 10, "B", 4)}
    return spark.createDataFrame([(*r, 1) for r in sorted(rows)], "seq_id long, seq_len long, pat string, site long, strand int")


@pytest.mark.parametrize("stretch", [1 << 16, 13])
@pytest.mark.parametrize("spec", ["A,g100,B", "A,-g100,B", "A,+g100,B", "A,g0,A", "A,-g20,A", "A,g5000,B"])
def test_far_sites(spark, sites, monkeypatch, stretch, spec):
    monkeypatch.setattr(proximity, "STRETCH", stretch)
    one = proximity.parse(spec)
    rows = sites.collect()
    ends = lambda name: {(r["seq_id"], r["site"]) for r in rows if r["pat"] == name}
    good = {0: lambda d: abs(d) > one.lo, -1: lambda d: d > one.lo, 1: lambda d: -d > one.lo}[one.direction]
    want = {(i, a, b) for i, a in ends(one.a) for j, b in ends(one.b) if i == j and good(b - a)}
    got = [tuple(r)[:3] for r in proximity.near(sites, spec).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = {(r["seq_id"], r["site_a"]): r["n"] for r in proximity.far_counts(sites, spec).collect()}
    assert counts == {k: len(list(g)) for k, g in itertools.groupby(sorted(want), key=lambda x: x[:2])}


def test_far_counts_are_for_far_searches(sites):
    with pytest.raises(ValueError):
        proximity.far_counts(sites, "A,l100,B")


@pytest.mark.parametrize("stretch", [1 << 16, 40])
def test_rule_windows_over_stretches(sites, monkeypatch, stretch):
    monkeypatch.setattr(windows, "STRETCH", stretch)
    for text in ("R,(A:1&B:2:3),30", "R,(A|B:2),150"):
        rule = parse_rule(text)
        rows = {(r["seq_id"], r["site"], r["pat"]) for r in sites.where("pat IN ('A', 'B')").collect()}
        want = set()
        for i, lo in {(i, s) for i, s, _ in rows}:
            inside = [(s, p) for j, s, p in rows if j == i and lo <= s <= lo + rule.window]
            a, b = (sum(p == x for _, p in inside) for x in "AB")
            if (a >= 1 and 2 <= b <= 3) if rule.window == 30 else (a >= 0 or b >= 2):
                want.add((i, lo, max(s for s, _ in inside), a, b))
        got = [(r["seq_id"], r["lo"], r["hi"], r["n_A"], r["n_B"]) for r in windows.rule_windows(sites, rule).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("stretch", [1 << 20, 17])
def test_fragments_over_stretches(sites, monkeypatch, stretch):
    monkeypatch.setattr(derive, "STRETCH", stretch)
    own = derive.distinct_sites(sites)
    by = {}
    for r in own.collect():
        by.setdefault((r["seq_id"], r["pat"], r["seq_len"]), []).append(r["site"])
    line, circle = set(), set()
    for (i, p, n), at in by.items():
        at.sort()
        ends = [0, *at, n]
        line |= {(i, p, k, a, b, b - a) for k, (a, b) in enumerate(zip(ends, ends[1:]), 1)}
        circle |= {(i, p, k, at[k - 2], b, b - at[k - 2] + (n if k == 1 else 0)) for k, b in enumerate(at, 1)}
    for circular, want in ((False, line), (True, circle)):
        got = [tuple(r) for r in derive.fragments(own, circular).select("seq_id", "pat", "frag_no", "begin_site", "end_site", "frag_len").collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("chunk", [1, 7, 1 << 17])
def test_degenerate_runs_over_chunks(spark, chunk):
    texts = ["nnacgtnn", "n" * 40, "acgt", "acnnryacgtnnnnnnnnnnnnnna", "", bases(300, 15, "acgnnnr"), "n"]
    want = {(i, m.start() + 1, m.end()) for i, t in enumerate(texts) for m in re.finditer("[^acgt]+", t)}
    for df in (whole(spark, texts), in_parts(spark, texts)):
        got = [tuple(r) for r in derive.degenerate_runs(df, chunk).collect()]
        assert len(got) == len(set(got)) and set(got) == want
