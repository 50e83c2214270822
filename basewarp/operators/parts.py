"""Sequences in parts: chromosomes that no row holds whole.

A table of parts has seq_id, seq_len, base (bases before the part) and bases; the parts of a sequence
follow each other without gap, in any lengths.  match.chunked takes such a table in place of
one with a row per sequence, so every search that works in chunks works on parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequence import reverse_complement

#: Parts whose lengths are summed before sums are: a prefix sum's window has a row for so many parts.
RUN = 4096


def is_parts(seqs: DataFrame) -> bool:
    return "bases" in seqs.columns


def join_parts(rows: DataFrame) -> DataFrame:
    """Parts of rows (seq_id, part_no, seq) that make up sequences in the order of part_no (unique in its sequence).

    Where each begins is a prefix sum of lengths in two levels, so no window has all parts of a sequence: within runs of part
    numbers, and over the runs' sums.
    """
    rows = rows.select("seq_id", "part_no", F.coalesce("seq", F.lit("")).alias("bases"), F.floor(F.col("part_no") / F.lit(RUN)).alias("_run"), F.coalesce(F.length("seq"), F.lit(0)).cast("long").alias("_n"))
    runs = rows.groupBy("seq_id", "_run").agg(F.sum("_n").alias("_sum"))
    by = Window.partitionBy("seq_id")
    runs = runs.select("seq_id", "_run", (F.sum("_sum").over(by.orderBy("_run")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(by).alias("seq_len"))
    inside = F.sum("_n").over(Window.partitionBy("seq_id", "_run").orderBy("part_no")) - F.col("_n")
    return rows.withColumn("_inside", inside).join(runs, ["seq_id", "_run"]).select("seq_id", "seq_len", (F.col("_before") + F.col("_inside")).alias("base"), "bases").where("bases <> ''")


def twin(seqs: DataFrame) -> DataFrame:
    """The reverse complements, in the form that the table has."""
    if is_parts(seqs):
        return seqs.select("seq_id", "seq_len", (F.col("seq_len") - F.col("base") - F.length("bases")).alias("base"), reverse_complement("bases").alias("bases"))
    return seqs.select("seq_id", reverse_complement("seq").alias("seq"))


def cut(parts: DataFrame, overlap: int, chunk: int, circular: bool = False) -> DataFrame:
    """Chunks of parts: seq_id, seq_len, base, own, piece, as match.chunked has them.

    Each part gives a slice to every chunk that it reaches into, and the slices of a chunk (its bases and ``overlap`` more)
    meet by (sequence, chunk): one shuffle of bases, however long a sequence is.
    """
    rows = parts.where(F.length("bases") > 0).select("seq_id", "seq_len", "base", F.col("bases").cast("binary").alias("_bytes"))
    if circular:  # the first bases once more, behind the end
        head = rows.where(F.col("base") < overlap).select("seq_id", "seq_len", (F.col("base") + F.col("seq_len")).alias("base"), F.substring("_bytes", F.lit(1), (F.lit(overlap) - F.col("base")).cast("int")).alias("_bytes"))
        rows = rows.unionByName(head)
    end = F.col("base") + F.octet_length("_bytes")
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("base") - overlap) / F.lit(chunk)))
    last = F.least(F.floor((end - 1) / F.lit(chunk)), F.floor((F.col("seq_len") - 1) / F.lit(chunk)))
    rows = rows.select("*", F.explode(F.sequence(first, F.greatest(first, last))).alias("_k"))
    lo: Column = F.greatest(F.col("base"), F.col("_k") * chunk)
    hi: Column = F.least(F.col("base") + F.octet_length("_bytes"), (F.col("_k") + 1) * chunk + overlap)
    rows = rows.where(hi > lo).select("seq_id", "seq_len", "_k", F.struct(lo.alias("at"), F.substring("_bytes", (lo - F.col("base") + 1).cast("int"), (hi - lo).cast("int")).alias("some")).alias("x"))
    each = rows.groupBy("seq_id", "seq_len", "_k").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # at most chunk + overlap bases
    piece = F.array_join(F.transform("xs", lambda x: x["some"].cast("string")), "")
    own = F.least(F.lit(chunk).cast("long"), F.col("seq_len") - F.col("_k") * chunk).cast("int")
    return each.select("seq_id", "seq_len", (F.col("_k") * chunk).cast("long").alias("base"), own.alias("own"), piece.alias("piece"))
