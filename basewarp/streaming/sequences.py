"""Searching a stream of sequences.

Every operator on single sequences is stateless, so it runs on each micro-batch as it is; part_stream keeps state for sequences that
arrive in parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sequence import normalise
from ..operators import derive, match
from ..plans.patterns import Pattern

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stream(spark: SparkSession, path: str, schema: str = SCHEMA, degenerate: bool = False) -> DataFrame:
    """Parquet files of doc_id and text as they arrive, as sequences."""
    docs = spark.readStream.schema(schema).parquet(path)
    return docs.select(F.col("doc_id").alias("seq_id"), normalise("text", degenerate).alias("seq"))


def site_stream(seqs: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Hits of a streaming sequence table, itself a streaming table (no state: append mode)."""
    return match.find_sites(seqs, patterns)


def each_batch(seqs: DataFrame, out: str, checkpoint: str, patterns: list[Pattern], then: Callable[[DataFrame], DataFrame] = derive.hit_counts) -> StreamingQuery:
    """Writes a table derived from each micro-batch's sites; a repeated batch overwrites its own part."""

    def one(batch: DataFrame, number: int) -> None:
        then(derive.distinct_sites(match.find_sites(batch, patterns))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return seqs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What is kept of a sequence that is still arriving: the number of its next part, the bases before the kept tail, the tail, and
#: parts that came early.
_STATE = "next long, base long, tail string, early_no array<long>, early array<string>"


def part_stream(parts: DataFrame, patterns: list[Pattern], delay: str = "1 hour") -> DataFrame:
    """Hits of sequences that arrive in parts: a streaming table of seq_id, part_no (from 0), seq, at (a timestamp).

    State carries each open sequence's last bases, so a hit over the edge of two parts is found when the second is there, and each
    hit once: with the part that completes its site and coordinate.  Early parts wait for those before them (the state holds them);
    parts that were there already are passed over.  A sequence of which nothing comes for ``delay`` beyond the newest timestamp is
    forgotten.  Output (append mode): seq_id, pat, strand, start, site.
    """
    kind = parts.schema["seq_id"].dataType.simpleString()
    jobs = [(p.name, strand, site, p.errors, shift) for p in patterns for strand, site, shift in p.strands()]
    reach = max((max(len(site), shift + 1) for _, _, site, _, shift in jobs), default=1)

    def run(key, batches, state):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        from ..operators.scan import Site, find

        if state.hasTimedOut:
            state.remove()
            return
        at, base, tail, numbers, texts = state.get if state.exists else (0, 0, "", [], [])
        waiting = dict(zip(numbers, texts))
        newest = 0
        for f in batches:
            newest = max(newest, int(f["at"].max().timestamp() * 1000))
            for no, text in zip(f["part_no"], f["seq"]):
                if no >= at:
                    waiting.setdefault(int(no), text or "")
        new = ""
        while at in waiting:
            new += waiting.pop(at)
            at += 1
        text, before, total = tail + new, base + len(tail), base + len(tail) + len(new)
        rows = []
        if new:
            sites = [Site(site, errors, "plain") for _, _, site, errors, _ in jobs]
            for job, _, starts in find(pa.array([text]), sites, np.array([len(text)])):
                name, strand, site, _, shift = jobs[job]
                for start in (base + starts).tolist():
                    done = max(start + len(site) - 1, start + shift)
                    if before < done <= total and start + shift >= 1:
                        rows.append((key[0], name, strand, start, start + shift))
        kept = text[max(0, len(text) - reach + 1) :]
        state.update((at, total - len(kept), kept, list(waiting), list(waiting.values())))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(rows, columns=["seq_id", "pat", "strand", "start", "site"])

    told = parts.withWatermark("at", delay)
    return told.groupBy("seq_id").applyInPandasWithState(run, f"seq_id {kind}, pat string, strand int, start long, site long", _STATE, "append", "EventTimeTimeout")
