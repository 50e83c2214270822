"""The engine against plain Python: scalar functions, patterns, matching, derived tables, rules, frames, files, streams."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basewarp import options, render
from basewarp.functions import codons as cod
from basewarp.functions import sequence as sq
from basewarp.operators import derive, match, orfs, proximity, scan, windows
from basewarp.plans import patterns as pt
from basewarp.plans.rules import bounded, parse_expression, parse_rule, parse_rules_file
from basewarp.sources import files
from basewarp.sources import sequences as src
from basewarp.streaming import sequences as streams

SEQS = [
    (1, "gaattc"),
    (2, "ttgatcgaattcgantcgatcgtctcaagagacgtac"),
    (3, ""),
    (4, "a"),
    (5, "gatc" * 40 + "tcgatcga" * 30),
    (6, "acgt" * 2100 + "gaattc" + "acgtt" * 1300 + "gtctcgagac"),
    (7, "aaaaaa"),
    (8, "ttcnnngaa"),
    (9, None),
]
SITES = [pt.pattern("EcoRI", "G'AATT_C"), pt.pattern("TaqI", "T'CG_A"), pt.pattern("BsmAI", "GTCTC", 6, 4), pt.pattern("MboI", "'GATC_"), pt.Pattern("aa", "aa")]


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame(SEQS, "seq_id long, seq string")


def fits(pattern, text, errors=0):
    return len(pattern) == len(text) and sum(not (len(sq.IUPAC[t]) == 1 and t in sq.IUPAC[p]) for p, t in zip(pattern, text)) <= errors


def brute_hits(rows, patterns, circular=False):
    out = set()
    for i, s in rows:
        for p in patterns if s else []:
            for strand, site, shift in p.strands():
                text = s + s[: p.length - 1] if circular else s
                for k in range(len(s) if circular else len(s) - p.length + 1):
                    if fits(site, text[k : k + p.length], p.errors):
                        at = k + 1 + shift
                        at = (at - 1) % len(s) + 1 if circular else at
                        if 1 <= at <= len(s):
                            out.add((i, p.name, strand, k + 1, at))
    return out


def found(df):
    return {(r["seq_id"], r["pat"], r["strand"], r["start"], r["site"]) for r in df.collect()}


def test_scalar_functions(spark):
    word = "acgtrymkbdhvwsn"
    r = spark.createDataFrame([(word,)], "s string").select(
        sq.complement("s").alias("c"), sq.reverse_complement("s").alias("rc"), sq.triplet_reverse(F.lit("abcdefgh")).alias("t"), sq.magnitude("s").alias("m"), sq.degeneracy(F.lit("acrbn")).alias("d"), sq.nmer_key(F.lit("acgt")).alias("k"), sq.nmer_key(F.lit("acgn")).alias("k0"), sq.is_palindrome(F.lit("grcgyc")).alias("p"), sq.normalise(F.lit("AcGUx-Nn"), True).alias("n"), sq.normalise(F.lit("AcGUx-Nn")).alias("n4")
    ).first()
    assert r["c"] == "tgcayrkmvhdbwsn" and r["rc"] == "tgcayrkmvhdbwsn"[::-1]
    assert r["t"] == "defabc" and r["m"] == 4 + 6 * 0.5 + 4 * 0.25 and r["d"] == 2 * 3 * 4
    assert r["k"] == 0 + 1 * 4 + 2 * 16 + 3 * 64 and r["k0"] == 0 and r["p"] and r["n"] == "acgtnn" and r["n4"] == "acgt"


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet=sq.LETTERS, max_size=30))
def test_reverse_complement_is_its_own_inverse(s):
    assert sq.plain_reverse_complement(sq.plain_reverse_complement(s)) == s


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=sq.LETTERS, min_size=1, max_size=4), st.text(alphabet=sq.LETTERS, min_size=1, max_size=4))
def test_degenerate_modes_are_set_relations(p, t):
    t = t.ljust(len(p), "n")[: len(p)]
    subset = all(set(sq.IUPAC[b]) <= set(sq.IUPAC[a]) for a, b in zip(p, t))
    overlap = all(set(sq.IUPAC[b]) & set(sq.IUPAC[a]) for a, b in zip(p, t))
    assert bool(re.fullmatch(sq.iupac_regex(p, "subset"), t)) == subset == sq.compatible(p, t)
    assert bool(re.fullmatch(sq.iupac_regex(p, "overlap"), t)) == overlap == sq.compatible(p, t, "overlap")
    assert sq.compatible(p, t, "pure") == (subset and set(t) <= set("acgt"))


def test_pattern_compiler():
    p = pt.pattern("EcoRI", "G'AATT_C")
    assert (p.site, p.top_cut, p.overhang, p.is_palindrome, p.magnitude) == ("gaattc", 1, 4, True, 6.0)
    assert pt.clean_site("nnG'ACn_n", 3) == ("gac", 1)
    assert pt.best_seed("nnacgtacgnn") == (2, "acgtac") and pt.best_seed("ac") == (0, "acnnnn")
    assert set(pt.variants("acg", 1)) == {"ncg", "ang", "acn"} and len(pt.variants("acgt", 2)) == 6
    assert pt.command_line_pattern("jjj,mmmmmm,1").errors == 1
    assert [x.name for x in pt.select(SITES, ["taqi"])] == ["TaqI"]
    with pytest.raises(KeyError):
        pt.select(SITES, ["none"])
    with pytest.raises(ValueError):
        pt.pattern("bad", "gaxtc")
    assert [pt.passes(p, overhang=x) for x in "5310"] == [True, False, True, False]
    assert pt.pattern("x", "AC", units=500, price=60).cost == 8


def test_site_coordinates():
    # The cut's coordinate is that of the base just after it.
    assert pt.pattern("EcoRI", "G'AATT_C").strands() == [(1, "gaattc", 1)]
    assert pt.pattern("BsmAI", "GTCTC", 6, 4).strands() == [(1, "gtctc", 6), (-1, "gagac", -5)]


@pytest.mark.parametrize("circular", [False, True])
def test_matching(seqs, circular):
    clean = [(i, s) for i, s in SEQS if s is not None and len(s) > 5]
    use = seqs.where("length(seq) > 5")
    want = brute_hits(clean, SITES, circular)
    assert found(match.find_sites(use, SITES, circular=circular)) == want
    assert found(match.find_sites(use, SITES, circular=circular, seeds=True)) == want
    if not circular:
        assert found(match.find_sites(seqs, SITES)) == brute_hits(SEQS, SITES)


def test_no_patterns_no_hits(seqs):
    assert match.find_sites(seqs, []).count() == match.find_sites(seqs, [], seeds=True).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="acgtacgtacgtrynwk", max_size=40), min_size=1, max_size=5), st.text(alphabet="acgtacgtrynwbk", min_size=1, max_size=9), st.sampled_from(match.MODES), st.integers(0, 2), st.integers(1, 12))
def test_scan_against_letters(texts, site, mode, errors, size):
    """Places of a site in arrays against the letters' base sets, over the edges of slices."""
    at, word = pt.best_seed(site, min(6, len(site)))
    modes = ["plain" if mode == "plain" or mode == "key" and at <= j < at + len(word) else "subset" if mode == "key" else mode for j in range(len(site))]

    def may(letter, t, m):
        own, other = set(sq.IUPAC[letter]), set(sq.IUPAC[t])
        return other <= own and (m == "subset" or len(other) == 1) if m != "overlap" else bool(own & other)

    want = set()
    for row, t in enumerate(texts):
        for k in range(len(t) - len(site) + 1):
            wrong = sum(not may(x, y, m) for x, y, m in zip(site, t[k:], modes))
            open_ = all(may("n", y, "plain" if mode == "plain" else "subset" if mode == "key" else mode) for y in t[k : k + len(site)])
            if wrong <= errors and (open_ or not errors):
                want.add((row, k + 1))
    old, scan.SLICE = scan.SLICE, size
    try:
        column = pa.array(texts, type=pa.string())
        got = [(int(r), int(k)) for _, rows, starts in scan.find(column, [scan.Site(site, errors, mode)], np.array([len(t) for t in texts])) for r, k in zip(rows, starts)]
    finally:
        scan.SLICE = old
    assert len(got) == len(set(got)) and set(got) == want


def test_degenerate_modes_by_number(spark):
    df = spark.createDataFrame([(1, "ttrgcacgnya"), (2, "gaattcgantc")], "seq_id long, seq string")
    o = lambda k: options.Options((pt.Pattern("p", "rgcnnnnya"), pt.Pattern("h", "gantc")), degeneracy=k)
    got = {k: {(r["seq_id"], r["pat"], r["start"]) for r in options.search(df, o(k))["hits"].where("strand = 1").collect()} for k in options.DEGENERACY}
    assert got[0] == set() and got[1] == got[3] == {(1, "p", 3), (2, "h", 7)}
    assert got[2] == set() and got[4] >= got[3]


def test_matching_over_chunks(seqs, monkeypatch):
    monkeypatch.setattr(match, "CHUNK", 7)
    use = seqs.where("length(seq) < 500")
    rows = [(i, s) for i, s in SEQS if s and len(s) < 500]
    pieces = match.chunked(use, 3, chunk=7).collect()
    assert sum(r["own"] for r in pieces) == sum(len(s) for _, s in rows)


@pytest.mark.parametrize("errors", [1, 2])
def test_mismatches(seqs, errors):
    ps = [pt.Pattern("e", "gaattc", errors=errors), pt.Pattern("f", "gtcya", errors=errors)]
    rows = [(i, s) for i, s in SEQS if s and len(s) < 500]
    want = {h for h in brute_hits(rows, ps)}
    # With an n the target may hold any base; plain targets are compared.
    got = found(match.find_sites(seqs.where("length(seq) < 500 AND seq NOT LIKE '%n%'"), ps))
    assert got == {h for h in want if "n" not in dict(rows)[h[0]]}


def test_regex_overlaps_and_strands(spark):
    df = spark.createDataFrame([(1, "aattaattccaa")], "seq_id long, seq string")
    got = found(match.find_regex(df, [("x", "aatt")]))
    twin = sq.plain_reverse_complement("aattaattccaa")
    want = {(1, "x", 1, m.start() + 1, m.start() + 1) for m in re.finditer("(?=aatt)", "aattaattccaa")}
    want |= {(1, "x", -1, 12 - m.start(), 12 - m.start()) for m in re.finditer("(?=aatt)", twin)}
    assert got == want


def test_regex_longer_than_the_overlap(spark):
    text = "c" * 8100 + "ggatcc" + "c" * 400 + "gaattc" + "c" * 9000 + "ttt"
    df = spark.createDataFrame([(1, text)], "seq_id long, seq string")
    got = found(match.find_regex(df, [("x", "ggatcc.{300,500}gaattc"), ("y", "ggatcc.*ttt"), ("z", "gga")]))
    assert {h[:4] for h in got if h[2] == 1} == {(1, "x", 1, 8101), (1, "y", 1, 8101), (1, "z", 1, 8101)}
    assert [match.greatest_length(rx) for rx in ("ac(g|t)a?", "a{2,5}", "ac+", "a(?=ccc)", "^ac")] == [4, 5, None, None, None]


def test_matrix(spark):
    counts = [(10, 0, 0, 0), (0, 0, 10, 0), (0, 0, 0, 10)]
    df = spark.createDataFrame([(1, "ccagtcc"), (2, "ccactcc"), (3, "ag")], "seq_id long, seq string")
    got = {(r["seq_id"], r["strand"], r["start"], r["score"]) for r in match.find_matrix(df, "m", counts, 100).collect()}
    assert got == {(1, 1, 3, 3000), (2, -1, 3, 3000)}
    assert match.consensus(counts) == "agt" and match.consensus([(5, 5, 0, 0), (4, 3, 3, 0), (3, 3, 3, 3)], 80) == "mvn"


def test_nmers(spark):
    df = spark.createDataFrame([(1, "acgna")], "seq_id long, seq string")
    assert [(r["start"], r["nmer"]) for r in match.nmers(df, 2).orderBy("start").collect()] == [(1, "ac"), (2, "cg")]
    with pytest.raises(ValueError):
        match.nmers(df, 21)


@pytest.mark.parametrize("n", [2, 5, 12])
def test_nmer_counts(seqs, n):
    want = {}
    for _, s in SEQS:
        for k in range(len(s or "") - n + 1):
            if set(s[k : k + n]) <= set("acgt"):
                want[s[k : k + n]] = want.get(s[k : k + n], 0) + 1
    assert {r["nmer"]: r["n"] for r in match.nmer_counts(seqs, n).collect()} == want


def test_distinct_nmers(seqs):
    want = {s[k : k + 4] for _, s in SEQS if s for k in range(len(s) - 3)}
    got = [r["nmer"] for r in match.distinct_nmers(seqs, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_fragments_add_up(seqs):
    s = derive.distinct_sites(match.find_sites(seqs, SITES))
    lengths = {i: len(x or "") for i, x in SEQS}
    for circular in (False, True):
        for r in derive.fragments(s, circular).groupBy("seq_id", "pat").agg(F.sum("frag_len").alias("n")).collect():
            assert r["n"] == lengths[r["seq_id"]]
    tagged = derive.tagged_digest(s, "TaqI").collect()
    own = {(r["seq_id"], r["site"]) for r in s.where("pat = 'TaqI'").collect()}
    assert tagged and all((r["seq_id"], r["begin_site"]) in own or (r["seq_id"], r["end_site"]) in own for r in tagged)


def test_masking_and_ranges(spark):
    df = spark.createDataFrame([(1, "aatcgatcaatcgaaa")], "seq_id long, seq string")
    taq = pt.pattern("TaqI", "T'CG_A", dam=1)
    hits = match.find_sites(df, [taq])
    dam = match.find_sites(df, [pt.DAM])
    assert {r["site"] for r in hits.collect()} == {4, 12} and {r["site"] for r in dam.collect()} == {5}
    assert {r["site"] for r in derive.masked(hits, dam, [taq], "dam").collect()} == {12}
    got = derive.clone_ranges(derive.distinct_sites(hits), [(4, 4, True), (5, 12, False)]).collect()[0]
    assert (got["rule_1"], got["rule_2"], got["all_met"]) == (1, 1, True)  # 12 is not strictly inside
    with pytest.raises(ValueError):
        derive.clone_ranges(hits, [(1, 10, True), (5, 20, False)])


def test_proximity_against_all_pairs(seqs):
    s = derive.distinct_sites(match.find_sites(seqs, SITES))
    rows = s.collect()
    for text in ("TaqI,30,MboI", "TaqI,g100,MboI", "TaqI,10-60,MboI", "TaqI,-l40,MboI", "TaqI,-g90,MboI", "TaqI,-5-50,MboI", "TaqI,+l40,MboI", "TaqI,+g90,MboI", "TaqI,+5-50,MboI", "TaqI,20,TaqI"):
        spec = proximity.parse(text)
        want = set()
        for a, b in itertools.product([r for r in rows if r["pat"] == spec.a], [r for r in rows if r["pat"] == spec.b]):
            d = b["site"] - a["site"]
            d = abs(d) if spec.direction == 0 else d * -spec.direction
            ok = d > spec.lo if spec.kind == "g" else spec.lo <= d <= spec.hi if spec.kind == "r" else d < spec.lo and (spec.direction == 0 or d > 0)
            if a["seq_id"] == b["seq_id"] and ok and not (spec.a == spec.b and a["site"] == b["site"]):
                want.add((a["seq_id"], a["site"], b["site"]))
        assert {(r["seq_id"], r["site_a"], r["site_b"]) for r in proximity.near(s, spec).collect()} == want, text
    assert [proximity.parse(f"a,{d},b").number for d in ("5", "g5", "5-9", "-5", "-g5", "-5-9", "+l5", "+g5", "+5-9")] == list(range(9))
    for bad in ("a,x5,b", "a,9-5,b", "a,l5-9,b"):
        with pytest.raises(ValueError):
            proximity.parse(bad)


def test_rules_have_no_precedence():
    r = parse_rule("R,(A:1:2|B:1&C:0:0),100")
    (left, op, right) = r.tree
    assert op == "&" and left[1] == "|" and [t.name for t in r.terms] == ["A", "B", "C"]
    assert (r.terms[0].least, r.terms[0].most, r.terms[1].most) == (1, 2, 32000)
    got = parse_rules_file("text\n..\n;x\nR1, ((A:1:8 | B) ^ \\\n (C:1)),866\n")
    assert got[0].window == 866 and got[0].tree[1] == "^"
    for bad in ("(A", "A)", "A&", "&A", "(A&(B)"):
        with pytest.raises(ValueError):
            parse_expression(bad)
    with pytest.raises(ValueError):
        parse_rule("R,(A),0")


def test_rule_windows(spark):
    rows = [(1, 100, "A", s) for s in (10, 20, 30, 90)] + [(1, 100, "B", s) for s in (20, 95)]
    s = spark.createDataFrame(rows, "seq_id long, seq_len long, pat string, site long")
    got = {(r["lo"], r["hi"], r["n_A"], r["n_B"]) for r in windows.rule_windows(s, "R,(A:2&B:1),20").collect()}
    assert got == {(10, 30, 3, 1), (20, 30, 2, 1)}
    assert windows.rule_tables(s, [parse_rule("R,(A:2&B:1),20"), parse_rule("Q,(A:1),5")]).count() == 2 + 4


def test_codon_tables(spark):
    assert cod.codon_table()["atg"] == "M" and cod.codon_table(1)["aga"] == "*" and len(cod.codon_table(degenerate=True)) > 64
    assert cod.codon_table(degenerate=True)["gcn"] == "A"
    assert cod.reverse_codons()["R"] == "mgn" and cod.reverse_codons()["L"] == "ytn" and cod.reverse_codons()["S"] == "wsn"
    with pytest.raises(ValueError):
        cod.codon_table(13)
    df = spark.createDataFrame([("atggcntaa",)], "seq string")
    r = df.select(cod.translate("seq").alias("a"), cod.translate("seq", degenerate=True).alias("b"), cod.translate("seq", 1, 0, 3, True).alias("c"), cod.translate("seq", 2).alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == ("MX*", "MA*", "MetAlaTer", "WX")


def test_silent_sequences_translate_alike(spark):
    plain = "".join(c for c, aa in cod.codon_table().items() if aa not in "RLS*")
    df = spark.createDataFrame([(1, plain)], "seq_id long, seq string")
    a = df.select(cod.translate("seq").alias("p")).first()["p"]
    assert orfs.silent(df).select(cod.translate("seq", degenerate=True).alias("p")).first()["p"] == a


def test_orfs(spark):
    df = spark.createDataFrame([(1, "gcagca" + "taa" + "gcaatggcagca" + "tga" + "atg")], "seq_id long, seq string")
    rows = [(r["aa_begin"], r["peptide"], r["bp_begin"], r["bp_end"]) for r in orfs.orfs(df, 1, [1]).orderBy("aa_begin").collect()]
    assert rows == [(1, "AA", 1, 6), (5, "MAA", 13, 21), (9, "M", 25, 27)]
    assert [r["peptide"] for r in orfs.orfs(df, 1, [1], require_met=False).orderBy("aa_begin").collect()] == ["AA", "AMAA", "M"]
    got = orfs.orf_properties(orfs.orfs(df, 3, [1])).first()
    assert abs(got["mol_wt_kd"] - (131.1926 + 2 * 71.0788 + 18.01528) / 1000) < 1e-9 and 5 < got["pi"] < 7
    assert {(r["frame"], r["place"]) for r in orfs.starts_and_stops(df, [1]).collect()} == {(1, -3), (1, 5), (1, -8), (1, 9)}
    assert "orf 1" in orfs.fasta(orfs.orfs(df, 3, [1])).first()["record"]


def test_extraction(spark):
    df = spark.createDataFrame([(1, "ccgagacttt")], "seq_id long, seq string")
    hits = match.find_sites(df, [pt.Pattern("b", "gtctc")])
    r = derive.extract(df, hits, 2, 1, True).first()
    assert (r["site"], r["lo"], r["hi"], r["bases"]) == (8, 6, 9, "aagt")


TEXTS = {
    "fasta": ">one first\nAC-GT\nNN\n>two\nGGCC\n",
    "genbank": "LOCUS       one\nDEFINITION  first\nORIGIN\n   1  AC-GTNN\n//\nLOCUS       two\nORIGIN\n   1  GG CC\n//\n",
    "embl": "ID   one\nDE   first\nSQ   7 BP\n     AC-GT NN   7\n//\nID   two\nSQ   4 BP\n     GGCC\n//\n",
    "nbrf": ">P1;one\nfirst\n AC-GT\n NN*\n>DL;two\n\n GGCC*\n",
    "ig": ";first\none\nAC-GT\nNN1\n;\ntwo\nGGCC1\n",
    "pir": "\\\\\\\nENTRY           one\nTITLE           first\nSEQUENCE\n                5        10\n      1  A C - G T\n      6 N N\n///\nENTRY           two\nSEQUENCE\n                5\n      1  G G C C\n///\n",
    "msf": " x  MSF: 7  Type: N  Check: 1 ..\n\n Name: one   Len: 7\n Name: two   Len: 7\n\n//\n\n one  AC-G TNN\n two  GG-- \n\n two  CC\n",
    "paup": "#NEXUS\n[x]\nbegin data;\n dimensions ntax=2;\n format datatype=dna;\n matrix\n\none AC-GT\ntwo GG\n\none NN\ntwo CC\n;\nend;\n",
}
SINGLE = {
    "gcg": "one\n  one  Length: 7  Check: 1  ..\n   1  AC-GT NN\n",
    "strider": "; ### from DNA Strider ;-)\n; DNA sequence  one, 7 bases.\n;\nAC-GT\nNN\n//\n",
    "fitch": "one, 7 bases.\n AC- GTN N\n",
}


@pytest.mark.parametrize("kind", [*TEXTS, *SINGLE])
def test_formats_hold_the_same_records(spark, tmp_path, kind):
    text = (TEXTS | SINGLE)[kind]
    assert src.detect(text) == kind
    (tmp_path / "f").write_text(text)
    got = {(r["name"], r["seq"], r["seq_len"]) for r in src.read_sequences(spark, str(tmp_path / "f")).collect()}
    assert got == ({("one", "acgtnn", 6)} if kind in SINGLE else {("one", "acgtnn", 6), ("two", "ggcc", 4)})
    if kind == "fasta":
        assert {(r["name"], r["seq"], r["seq_len"]) for r in src.read_sequences(spark, str(tmp_path / "f"), "fasta").collect()} == got


def test_raw_text_and_subsequence(spark, tmp_path):
    (tmp_path / "f").write_text("It's a RAW text, ugh\nacgt")
    assert src.read_sequences(spark, str(tmp_path / "f"), "raw", degenerate=False).first()["seq"] == "taatttgacgt"
    docs = spark.createDataFrame([(1, "xxACGTxx")], "doc_id long, text string")
    assert src.from_text(docs, False, 4, 5).first()["seq"] == "cg"


def test_pattern_files(spark, tmp_path):
    (tmp_path / "p").write_text("header\n..\n;skip 1 AC 0 0 100 100 0 0 !\nAccI  2 GT'mk_AC 2 0 100 100 2500 220 ! x >AB\nShort 0 acgt\n")
    a, b = files.read_patterns(spark, str(tmp_path / "p"))
    assert (a.site, a.top_cut, a.overhang, a.cost, b.site, b.dam) == ("gtmkac", 2, 2, 11, "acgt", 100)
    assert files.parse_regexes("x\n..\n;no a !\nLongerThanTen  ac{2,3}t ! y\n") == [("LongerThan", "ac{2,3}t")]
    m = files.parse_matrices("AC  M1\nNA  thing\nDE  words\nP0  A C G T\n01 1 2 3 4 N\n02 0 0 9 1 G\nXX\n//\n")
    assert m == [{"name": "thing", "acc": "M1", "descr": "words", "counts": [(1.0, 2.0, 3.0, 4.0), (0.0, 0.0, 9.0, 1.0)]}]
    cells = "\n".join(f"{c.upper()}  {aa}{cod.THREE[aa]}" for c, aa in cod.codon_table(2).items())
    assert files.parse_codons(f"# c\nLabel Yeast\n{cells}\n") == [("Yeast", cod.codon_table(2))]
    assert files.command_line_regex("Lab:ac(g|t)") == ("Lab", "ac(g|t)")
    assert files.search(str(tmp_path / "p")) == str(tmp_path / "p")
    with pytest.raises(FileNotFoundError):
        files.search("no-such-file")
    files.log_patterns(spark, SITES[:2], str(tmp_path / "log"))
    files.log_patterns(spark, SITES[2:3], str(tmp_path / "log"))
    assert len(files.parse_patterns("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()))) == 3


def test_reports_are_whole(spark):
    n = render.ROWS + 5
    cells = spark.range(n).selectExpr("printf('p%06d', id) AS pat", "1 AS cell", "'x' AS mark", "1L AS n")
    for text in (render.ladder(cells, 3), render.gel(cells, 3), render.postscript_ladder(cells, 3)):
        assert f"p{n - 1:06d}" in text
    lines = spark.range(n).selectExpr("1L AS seq_id", "id AS block_no", "id * 2 + 1 AS begin", "'ac' AS bases", "'tg' AS other", "'' AS labels")
    assert f"ac  {2 * n}" in render.linear_map(lines)
    angles = spark.range(3).selectExpr("id * 1000 AS angle", "'p' AS pat", "id AS site")
    assert "more sites follow" in render.plasmid(angles, "p", 9, 2) and "more sites follow" not in render.plasmid(angles, "p", 9)


def test_reports(spark, seqs):
    own = seqs.where("seq_id = 2")
    s = derive.distinct_sites(match.find_sites(own, SITES))
    text = render.linear_map(derive.linear_map(own, s, 20))
    assert "MboI" in text and "ttgatcgaattcgantcgat" in text
    assert "TaqI" in render.ladder(derive.ladder_cells(s, 30), 30)
    assert "TaqI" in render.gel(derive.gel_cells(derive.fragments(s), 20, 2, 100), 20)
    assert "showpage" in render.plasmid(derive.plasmid_angles(s), "p", 37) and "TaqI" in render.postscript_ladder(derive.ladder_cells(s, 30), 30)
    lanes = render.proximity_ladder(s, proximity.near(s, "TaqI,30,MboI"), "TaqI", "MboI", 30)
    assert lanes.select("pat").distinct().count() == 4
    assert '<a href="#s0">Sites</a>' in render.page([("Sites", render.table(derive.sites_table(s), "Sites"))])


def test_search_with_options(seqs):
    options.register_matcher("mine", lambda df: df.select("seq_id", F.length("seq").cast("long").alias("seq_len"), F.lit("mine").alias("pat"), F.lit(1).alias("strand"), F.lit(1).cast("long").alias("start"), F.lit(1).cast("long").alias("site")).where("seq_len > 0"))
    o = options.Options(tuple(SITES), magnitude=4, max_hits=50, dam=True, proximity=("TaqI,30,MboI",), rules=(parse_rule("R,(TaqI:1&MboI:1),50"),), clone=((1, 20, True),), matchers=("mine",))
    out = options.search(seqs, o)
    assert [p.name for p in options.chosen(o)] == ["EcoRI", "TaqI", "BsmAI", "MboI"]
    assert out["hits"].where("pat = 'mine'").count() == 7
    assert all(df.schema for df in out.values()) and out["rule R"].count() > 0 and out["clone"].count() > 0
    assert options.chosen(options.Options(tuple(SITES), names=("aa",), magnitude=4))[0].name == "aa"


def test_search_covers_the_command_line(seqs):
    counts = ((0, 0, 10, 0), (10, 0, 0, 0), (0, 0, 0, 10))
    o = options.Options(tuple(SITES), regexes=(("rx", "gat+c"),), matrices=(("m", counts, 100),), extract=(3, 3, True), begin=2, end=60, turn="revcomp", clone=((1, 20, True), (30, 40, False)), codon_table=1)
    out = options.search(seqs, o)
    assert {r["pat"] for r in out["hits"].select("pat").distinct().collect()} >= {"rx", "TaqI", "m"}
    assert out["extract"].count() and out["linear map"].count() and out["starts and stops"].count() and out["expected"].count() and out["gel"].count()
    assert {r["section"] for r in out["clone ladder"].select("section").distinct().collect()} <= {0, 1, 2}
    assert {r["seq_len"] for r in out["sites"].collect()} <= set(range(60))
    assert all(df.schema for df in out.values())
    with pytest.raises(ValueError):
        options.search(seqs, options.Options(turn="around"))
    silent = options.search(seqs, options.Options((pt.Pattern("r", "gaytt"),), silent=True))
    assert silent["hits"].schema == out["hits"].schema


def test_own_bounds(seqs):
    s = derive.distinct_sites(match.find_sites(seqs, SITES))
    n = {(r["seq_id"], r["pat"]): r["n_hits"] for r in derive.hit_counts(s).collect()}
    own = bounded(SITES, [parse_rule("R,(ecori:1:1&MboI:2:50),10"), parse_rule("S,(MboI:7:7),10")])
    assert [(p.min_hits, p.max_hits) for p in own if p.name in ("EcoRI", "MboI", "TaqI")] == [(1, 1), (1, 32000), (2, 50)]
    got = {(r["seq_id"], r["pat"]) for r in derive.between_own_hits(s, own, 1, 40).collect()}
    most = {"EcoRI": (1, 1), "MboI": (2, 50)}
    assert got == {k for k, v in n.items() if most.get(k[1], (1, 40))[0] <= v <= most.get(k[1], (1, 40))[1]}


def test_regex_option_reads_a_file(spark, tmp_path):
    (tmp_path / "rx").write_text("head\n..\none ga+t ! text\n;no\ntwo cc\n")
    assert files.regex_option(spark, f"FILE:{tmp_path}/rx") == [("one", "ga+t"), ("two", "cc")]
    assert files.regex_option(spark, "x:ga") == [("x", "ga")]


def test_readers_split_large_files(spark, tmp_path):
    text = "".join(f"LOCUS       d{i} x\nDEFINITION  t\nORIGIN\n        1 acgtn{'ac' * i}\n//\n" for i in range(300))
    (tmp_path / "a.gb").write_text(text)
    (tmp_path / "crlf.gb").write_text(text.replace("\n", "\r\n"))
    for name in ("a.gb", "crlf.gb"):
        got = {r["name"]: r["seq"] for r in src.read_sequences(spark, str(tmp_path / name), "genbank").collect()}
        assert got == {f"d{i}": "acgtn" + "ac" * i for i in range(300)}


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    path = "/root/testdata/sf0.001/documents.parquet"
    (tmp_path / "in").mkdir()
    spark.read.parquet(path).limit(60).repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    use = [SITES[1], SITES[3]]
    seqs = streams.stream(spark, str(tmp_path / "in"))
    assert streams.site_stream(seqs, use).isStreaming
    q = streams.each_batch(seqs, str(tmp_path / "out"), str(tmp_path / "cp"), use)
    q.awaitTermination(120)
    batch = src.from_text(spark.read.parquet(str(tmp_path / "in")))
    want = {tuple(r) for r in derive.hit_counts(derive.distinct_sites(match.find_sites(batch, use))).collect()}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()} == want and want
