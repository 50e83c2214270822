"""What keeps time and memory in proportion to the input: work done once for a plan's parts, nothing held whole."""

import tracemalloc

import pytest

from basewarp.functions import codons as cod
from basewarp.functions import sequence as sq
from basewarp.operators import orfs
from basewarp.operators.parts import join_parts
from basewarp.sources import sequences, split


def walks(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_stretches_of_parts_are_found_once(spark):
    parts = join_parts(spark.createDataFrame([(1, k, "atgaaattttagccc" * 20) for k in range(5)], "seq_id long, part_no long, seq string"))
    found = orfs.orfs(parts, 3, chunk=30)
    assert walks(found) == 0
    whole = orfs.orfs(spark.createDataFrame([(1, "atgaaattttagccc" * 100)], "seq_id long, seq string"), 3)
    assert sorted(map(tuple, found.select(sorted(found.columns)).collect())) == sorted(map(tuple, whole.select(sorted(whole.columns)).collect()))


@pytest.mark.parametrize("kind,text", [("gcg", "a title\n\nd1  Length: 9  ..\n\n  1  acgt\nacgg\n"), ("strider", "; ### from DNA Strider ###\n; DNA sequence d1, 9 bp\n;\nacgt\nacgg\n//\n"), ("msf", " x  MSF: 9  Type: N  Check: 1 ..\n\n Name: d1  Len: 9\n\n//\n\nd1 acgt\n\nd1 acgg\n")])
def test_lines_are_walked_once_for_headers_and_parts(spark, tmp_path, kind, text):
    (tmp_path / "a.seq").write_text(text)
    headers, parts = split.read_both(spark, str(tmp_path), kind)
    assert walks(headers) == walks(parts) == 0
    got = parts.join(headers, "seq_id").orderBy("base").select("name", "bases").collect()
    assert ("d1", "acgtacgg") == (got[0]["name"], "".join(r["bases"] for r in got))


def test_ig_records_come_one_by_one():
    text = "".join(f"; title {k}\nd{k}\n" + "acgtacgtac" * 50 + "\nacg1\n\n" for k in range(10_000))
    tracemalloc.start()
    try:
        n = sum(seq == "acgtacgtac" * 50 + "acg" and (name, descr) == (f"d{k}", f"title {k}") for k, (name, descr, seq) in enumerate(sequences._ig(text)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 10_000 and peak < len(text) / 10


def test_letters_are_counted_without_expressions(spark):
    assert "regexp" not in str(sq.count_of("seq", "acgt")).lower()
    df = spark.createDataFrame([("aaccgtnnry",), ("",), (None,)], "seq string")
    assert [tuple(r) for r in df.select(sq.count_of("seq", "acgt"), sq.count_of("seq", "n")).collect()] == [(6, 2), (0, 0), (None, None)]


@pytest.mark.parametrize("at_once", [1, 7, 1 << 20])
def test_translations_by_all_tables(spark, at_once):
    rows = [(1, "atgagaataaaatgactg"), (2, ""), (3, None), (4, "ac"), (5, "atnctgttaa"), (6, "aga" * 9)]
    df = spark.createDataFrame(rows, "seq_id long, seq string").coalesce(1)
    want = {(r["seq_id"], k, r["p"]) for k in cod.DIFFERENCES for r in df.select("seq_id", cod.translate("seq", 1, k).alias("p")).collect()}
    got = [tuple(r) for r in orfs.translations(df, tuple(cod.DIFFERENCES), at_once).collect()]
    assert len(got) == 6 * 13 and set(got) == want
