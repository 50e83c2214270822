"""Sequences that arrive in parts, over micro-batches and a restart."""

import random

from pyspark.sql import functions as F

from basewarp.operators import match
from basewarp.plans import patterns as pt
from basewarp.streaming import sequences as streams

PATTERNS = [pt.pattern("EcoRI", "G'AATT_C"), pt.pattern("BsmAI", "GTCTC", 6, 4), pt.Pattern("e", "gatcc", errors=1)]
SCHEMA = "seq_id long, part_no long, seq string, at timestamp"


def run_all(spark, tmp_path):
    parts = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.part_stream(parts, PATTERNS).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(180)
    assert q.exception() is None and not q.isActive


def test_parts_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(3)
    texts = {1: "".join(rng.choices("acgt", k=2000)) + "gaattcgtctc", 2: "gaat" * 40 + "gtctcaaaaa", 3: "g"}
    rows = []
    for i, text in texts.items():
        cuts = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(11))})
        rows += [(i, k, text[a:z]) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]
    rows.append((1, len([r for r in rows if r[0] == 1]), None))
    files = [[] for _ in range(8)]
    for i, k, seq in rows:
        files[min(7, k * 8 // 12) if rng.random() < 0.8 else rng.randint(0, 7)].append((i, k, seq))  # some early, some late
    files[6] += files[1][:2]  # once more
    add = lambda own: spark.createDataFrame(own, "seq_id long, part_no long, seq string").withColumn("at", F.to_timestamp(F.lit("2026-01-01 00:00:00"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for own in files[:4]:
        add(own or [(9, 0, "")])
    run_all(spark, tmp_path)
    for own in files[4:]:
        add(own or [(9, 0, "")])
    run_all(spark, tmp_path)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    whole = spark.createDataFrame(list(texts.items()), "seq_id long, seq string")
    want = {tuple(r) for r in match.find_sites(whole, PATTERNS).select("seq_id", "pat", "strand", "start", "site").collect()}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_forgotten_sequences_start_anew(spark, tmp_path):
    def add(rows, at):
        spark.createDataFrame(rows, "seq_id long, part_no long, seq string").withColumn("at", F.to_timestamp(F.lit(at))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    add([(1, 0, "ttgaa")], "2026-01-01 00:00:00")
    run_all(spark, tmp_path)
    add([(2, 0, "a")], "2026-01-03 00:00:00")  # the watermark passes sequence 1
    run_all(spark, tmp_path)
    add([(2, 1, "a")], "2026-01-03 00:00:01")
    run_all(spark, tmp_path)
    add([(1, 0, "gaattc"), (2, 2, "gaattc")], "2026-01-03 00:00:02")
    run_all(spark, tmp_path)
    assert {tuple(r)[:4] for r in spark.read.parquet(str(tmp_path / "out")).where("pat = 'EcoRI'").collect()} == {(1, "EcoRI", 1, 1), (2, "EcoRI", 1, 3)}
