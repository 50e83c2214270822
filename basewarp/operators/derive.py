"""Tables derived from hits: distinct sites, counts, fragments, digests, bins, masking, ranges, extraction and map cells."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequence import complement
from ..plans.patterns import Pattern
from .match import CHUNK, chunked

#: Bases of a stretch whose sites one window holds.
STRETCH = 1 << 20


def distinct_sites(hits: DataFrame) -> DataFrame:
    """One row per sequence, pattern and coordinate."""
    return hits.groupBy("seq_id", "seq_len", "pat", "site").agg(F.max("strand").alias("strand"))


def sites_table(hits: DataFrame, signed: bool = False) -> DataFrame:
    """Sorted sites per sequence and pattern as text; signed: bottom-strand sites negative."""
    rows = hits.select("seq_id", "pat", "site", "strand").distinct() if signed else hits.select("seq_id", "pat", "site").distinct()
    value = F.transform(F.array_sort(F.collect_list(F.struct("site", "strand"))), lambda x: (x["site"] * x["strand"]).cast("string")) if signed else F.transform(F.array_sort(F.collect_list("site")), lambda x: x.cast("string"))
    return rows.groupBy("seq_id", "pat").agg(F.count(F.lit(1)).alias("n_sites"), F.array_join(value, " ").alias("sites"))


def hit_counts(sites: DataFrame) -> DataFrame:
    """Sites per sequence and pattern."""
    return sites.groupBy("seq_id", "pat").agg(F.count(F.lit(1)).alias("n_hits"))


def pattern_summary(sites: DataFrame) -> DataFrame:
    return sites.groupBy("pat").agg(F.count_distinct("seq_id").alias("n_seqs"), F.count(F.lit(1)).alias("n_hits"), F.sum("site").alias("site_sum"))


def pattern_names(sites: DataFrame, names: list[str]) -> DataFrame:
    return sites.sparkSession.createDataFrame([(n,) for n in names], "pat string")


def zero_cutters(sites: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Patterns without a site in any sequence."""
    return pattern_names(sites, [p.name for p in patterns]).join(sites.select("pat").distinct(), "pat", "left_anti")


def between_hits(sites: DataFrame, least: int = 1, most: int = 32000) -> DataFrame:
    """Sequence and pattern with least to most sites."""
    return hit_counts(sites).where(F.col("n_hits").between(least, most))


def between_own_hits(sites: DataFrame, patterns: list[Pattern], least: int = 1, most: int = 32000) -> DataFrame:
    """The same with each pattern's own bounds, if it has any, in place of least and most."""
    plain = Pattern("", "")
    own = [(p.name, p.min_hits, p.max_hits) for p in patterns if (p.min_hits, p.max_hits) != (plain.min_hits, plain.max_hits)]
    bounds = sites.sparkSession.createDataFrame(own, "pat string, own_least int, own_most int")
    counted = hit_counts(sites).join(F.broadcast(bounds) if len(own) <= 100_000 else bounds, "pat", "left")
    return counted.where(F.col("n_hits").between(F.coalesce("own_least", F.lit(least)), F.coalesce("own_most", F.lit(most)))).select("seq_id", "pat", "n_hits")


def strider_order(sites: DataFrame) -> DataFrame:
    """Patterns of each sequence by number of sites and then name, numbered."""
    w = Window.partitionBy("seq_id").orderBy("n_hits", "pat")
    return hit_counts(sites).withColumn("place", F.row_number().over(w).cast("long"))


def with_hits(seqs: DataFrame, hits: DataFrame) -> DataFrame:
    """Sequences that have a hit."""
    return seqs.join(hits.select("seq_id").distinct(), "seq_id", "left_semi")


def _neighbours(sites: DataFrame) -> DataFrame:
    """Sites with before (the site before, null at the first), place (from 1) and final (the last site) of their sequence and pattern.

    In two levels, so no window has all sites of a long sequence: within stretches of STRETCH bases, and over a row per stretch
    that carries its last site and its count to those behind.
    """
    rows = sites.select("seq_id", "pat", "seq_len", "site", F.floor(F.col("site") / F.lit(STRETCH)).alias("_k"))
    by, all_ = Window.partitionBy("seq_id", "pat").orderBy("_k"), Window.partitionBy("seq_id", "pat")
    edges = rows.groupBy("seq_id", "pat", "_k").agg(F.max("site").alias("_last"), F.count(F.lit(1)).alias("_n"))
    edges = edges.select("seq_id", "pat", "_k", F.lag("_last").over(by).alias("_carried"), (F.sum("_n").over(by) - F.col("_n")).alias("_skip"), F.max("_last").over(all_).alias("final"))
    inside = Window.partitionBy("seq_id", "pat", "_k").orderBy("site")
    rows = rows.withColumn("_before", F.lag("site").over(inside)).withColumn("_place", F.row_number().over(inside))
    return rows.join(edges, ["seq_id", "pat", "_k"]).select("seq_id", "pat", "seq_len", "site", F.coalesce("_before", "_carried").alias("before"), (F.col("_skip") + F.col("_place")).alias("place"), "final")


def fragments(sites: DataFrame, circular: bool = False) -> DataFrame:
    """Fragments of each sequence and pattern: frag_no, begin_site, end_site, frag_len.

    Linear: from the start, between sites, to the end (sites + 1 fragments).  Circular: as many as sites;
    the first goes round the origin.
    """
    rows = _neighbours(sites)
    if circular:
        first = F.col("before").isNull()
        return rows.select("seq_id", "pat", F.col("place").alias("frag_no"), F.when(first, F.col("final")).otherwise(F.col("before")).alias("begin_site"), F.col("site").alias("end_site"), F.when(first, F.col("site") + F.col("seq_len") - F.col("final")).otherwise(F.col("site") - F.col("before")).alias("frag_len"))
    both = F.array(F.struct(F.col("place").alias("frag_no"), F.coalesce("before", F.lit(0).cast("long")).alias("begin_site"), F.col("site").alias("end_site")), F.struct((F.col("place") + 1).alias("frag_no"), F.col("site").alias("begin_site"), F.col("seq_len").alias("end_site")))
    rows = rows.select("seq_id", "pat", F.explode(F.slice(both, F.lit(1), F.when(F.col("site") == F.col("final"), 2).otherwise(1))).alias("f"))
    return rows.select("seq_id", "pat", "f.frag_no", "f.begin_site", "f.end_site", (F.col("f.end_site") - F.col("f.begin_site")).alias("frag_len"))


def combined(sites: DataFrame, name: str = "Combined") -> DataFrame:
    """The union of all sites as those of one pattern."""
    return sites.select("seq_id", "seq_len", F.lit(name).alias("pat"), "site").distinct()


def tagged_digest(sites: DataFrame, tagged: str) -> DataFrame:
    """Fragments of the combined digest of which at least one end is a site of the tagged pattern."""
    ends = sites.where(F.col("pat") == tagged).select("seq_id", F.col("site").alias("end")).distinct()
    frags = fragments(combined(sites))
    long = frags.select("*", F.explode(F.array("begin_site", "end_site")).alias("end"))
    return long.join(ends, ["seq_id", "end"], "left_semi").select(*frags.columns).distinct()


def binned(sites: DataFrame, size: int) -> DataFrame:
    """Sites per bin of ``size`` bases; a bin is named by its upper edge."""
    edge = ((F.floor(F.col("site") / F.lit(size)) + 1) * size).cast("long")
    return sites.groupBy("seq_id", "pat", edge.alias("bin")).agg(F.count(F.lit(1)).alias("n_hits"))


def binned_wide(sites: DataFrame, size: int, names: list[str]) -> DataFrame:
    """A row per sequence and bin, empty bins too, a column per pattern."""
    edge = ((F.floor(F.col("site") / F.lit(size)) + 1) * size).cast("long")
    full = sites.select("seq_id", "seq_len").distinct().select("seq_id", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("seq_len") / F.lit(size)) + 1)).alias("k")).select("seq_id", (F.col("k") * size).alias("bin"))
    wide = sites.groupBy("seq_id", edge.alias("bin")).pivot("pat", names).count()
    return full.join(wide, ["seq_id", "bin"], "left").na.fill(0, names)


def masked(hits: DataFrame, methyl: DataFrame, patterns: list[Pattern], kind: str) -> DataFrame:
    """Hits that methylation does not block.  methyl: hits of the methylase's own site (dam or dcm).

    A sensitive pattern's offset (100: not sensitive) gives the coordinate that must not be such a site:
    site + offset on the top strand, site - offset + overhang - the methylase site's length on the bottom.
    """
    back = {"dam": 4, "dcm": 5}[kind]
    offsets = hits.sparkSession.createDataFrame([(p.name, getattr(p, kind), p.overhang) for p in patterns if getattr(p, kind) != 100] or [], "pat string, off int, olap int")
    keyed = hits.join(F.broadcast(offsets) if len(patterns) <= 100_000 else offsets, "pat", "left")
    where = F.when(F.col("strand") == 1, F.col("site") + F.col("off")).otherwise(F.col("site") - F.col("off") + F.col("olap") - back)
    taken = methyl.select("seq_id", F.col("site").alias("blocked")).distinct()
    return keyed.withColumn("blocked", where).join(taken, ["seq_id", "blocked"], "left_anti").select(*hits.columns)


def clone_ranges(sites: DataFrame, ranges: list[tuple[int, int, bool]]) -> DataFrame:
    """pat, seq_id, per range whether it is met (rule_1 ...), n_met, all_met.  ranges: (begin, end, must cut).

    A must-cut range needs a site within it, ends included; in a forbidden one no site may lie strictly inside.
    """
    for b1, e1, m1 in ranges:
        for b2, e2, m2 in ranges:
            if m1 and not m2 and b1 <= e2 and b2 <= e1:
                raise ValueError(f"ranges {b1}-{e1} and {b2}-{e2} conflict")
    met = []
    for k, (b, e, must) in enumerate(ranges, 1):
        inside = F.col("site").between(b, e) if must else (F.col("site") > b) & (F.col("site") < e)
        hit = F.max(inside.cast("int"))
        met.append((hit if must else 1 - hit).cast("long").alias(f"rule_{k}"))
    out = sites.groupBy("seq_id", "pat").agg(*met)
    n = sum((F.col(f"rule_{k}") for k in range(2, len(ranges) + 1)), F.col("rule_1"))
    return out.withColumn("n_met", n).withColumn("all_met", F.col("n_met") == len(ranges))


def clone_ladder(sites: DataFrame, ranges: list[tuple[int, int, bool]], width: int) -> DataFrame:
    """Ladder cells per section: section 0 the patterns that meet all ranges, section k those that meet range k and have no
    site in a forbidden one."""
    met = clone_ranges(sites, ranges)
    forbidden = [F.col(f"rule_{k}") == 1 for k, (_, _, must) in enumerate(ranges, 1) if not must]
    clean = functools.reduce(lambda a, b: a & b, forbidden, F.lit(True))
    sections = [F.when(F.col("all_met"), F.lit(0))] + [F.when(clean & (F.col(f"rule_{k}") == 1), F.lit(k)) for k in range(1, len(ranges) + 1)]
    shown = met.select("seq_id", "pat", F.explode(F.array(*sections)).alias("section")).where("section IS NOT NULL")
    return ladder_cells(sites, width).join(shown, ["seq_id", "pat"]).select("seq_id", "section", "pat", "cell", "n", "mark")


def extract(seqs: DataFrame, hits: DataFrame, before: int, after: int, turn: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Bases from site - before to site + after (clamped) around each hit; turn: bottom-strand hits reverse-complemented.

    Hits meet the chunk of sequence that holds their context, not the whole sequence.
    """
    lo, hi = F.greatest(F.lit(1).cast("long"), F.col("site") - before), F.least(F.col("seq_len"), F.col("site") + after)
    at = hits.withColumn("lo", lo).withColumn("hi", hi).withColumn("base", (F.floor((F.col("lo") - 1) / chunk) * chunk).cast("int"))
    pieces = chunked(seqs, before + after, chunk=chunk).select("seq_id", "base", "piece")
    part = F.substring("piece", (F.col("lo") - F.col("base")).cast("int"), (F.col("hi") - F.col("lo") + 1).cast("int"))
    if turn:
        part = F.when(F.col("strand") == -1, F.reverse(complement(part))).otherwise(part)
    return at.join(pieces, ["seq_id", "base"]).select("seq_id", "pat", "strand", "site", "lo", "hi", part.alias("bases"))


def ladder_cells(sites: DataFrame, width: int) -> DataFrame:
    """Cells of a map of ``width`` columns: sites per cell and its mark (a bar, a digit, or * over nine)."""
    cell = (F.floor(F.lit(0.5) + F.col("site") * F.lit(float(width)) / F.col("seq_len")) - 1).cast("long")
    cells = sites.withColumn("cell", F.greatest(F.lit(0).cast("long"), cell)).groupBy("seq_id", "pat", "cell").agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("mark", F.when(F.col("n") == 1, "|").when(F.col("n") <= 9, F.col("n").cast("string")).otherwise("*"))


def few_cutters(sites: DataFrame) -> DataFrame:
    """Patterns that cut a sequence rarely: at most log10(length) - 2 times beyond 10,000 bases, else once."""
    n = sites.groupBy("seq_id", "seq_len", "pat").agg(F.count(F.lit(1)).alias("n_hits"), F.min("site").alias("first_site"))
    most = F.when(F.col("seq_len") > 10000, F.floor(F.log10("seq_len")) - 2).otherwise(1)
    return n.where(F.col("n_hits") <= most).select("seq_id", "pat", "n_hits", "first_site")


def gel_cells(frags: DataFrame, width: int, low: int, high: int) -> DataFrame:
    """Bands per cell of a logarithmic gel from low to high bases; shorter fragments are in cell 0."""
    lo, hi = F.log10(F.lit(float(low))), F.log10(F.lit(float(high)))
    at = F.floor(F.lit(0.5) + F.lit(float(width)) * (F.log10(F.col("frag_len").cast("double")) - lo) / (hi - lo)).cast("long")
    cell = F.when(F.col("frag_len") < low, 0).otherwise(F.least(F.lit(width), at)).cast("long")
    return frags.groupBy("seq_id", "pat", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def plasmid_angles(sites: DataFrame) -> DataFrame:
    """Where a site stands on a circle, in thousandths of a degree."""
    return sites.select("seq_id", "pat", "site", F.floor(F.col("site") * 360000 / F.col("seq_len")).cast("long").alias("angle"))


def linear_map(seqs: DataFrame, sites: DataFrame, width: int = 60) -> DataFrame:
    """Lines of a map: block_no, begin, the bases, the other strand, and the patterns that cut there."""
    lines = chunked(seqs, 0, chunk=width).select("seq_id", F.floor(F.col("base") / width).cast("long").alias("block_no"), (F.col("base") + 1).cast("long").alias("begin"), F.col("piece").alias("bases"))
    label = sites.select("seq_id", F.floor((F.col("site") - 1) / width).cast("long").alias("block_no"), F.struct("site", "pat").alias("x"))
    labels = label.groupBy("seq_id", "block_no").agg(F.array_join(F.transform(F.array_sort(F.collect_set("x")), lambda x: F.concat_ws(":", x["pat"], x["site"].cast("string"))), " ").alias("labels"))
    return lines.join(labels, ["seq_id", "block_no"], "left").select("seq_id", "block_no", "begin", "bases", complement("bases").alias("other"), F.coalesce("labels", F.lit("")).alias("labels"))


def label_layout(sites: DataFrame, width: int = 60) -> DataFrame:
    """Where each label of a map's lines stands: seq_id, block_no, label_row (from 1, nearest the bases), col (from 0), pat, site.

    A label begins at its site's column, or further left if it would stick out of the line.  From left to right each takes the
    lowest row whose last label ends a blank before it, which needs as few rows as labels ever lie over one column; none is lost.
    A line's labels are folded as one array, so what one row holds is bounded by the width and the patterns.
    """
    col = F.least(F.pmod(F.col("site") - 1, F.lit(width)), F.greatest(F.lit(width).cast("long") - F.length("pat"), F.lit(0).cast("long"))).cast("long")
    labels = sites.select("seq_id", F.floor((F.col("site") - 1) / width).cast("long").alias("block_no"), F.struct(col.alias("col"), "site", "pat").alias("x"))
    lines = labels.groupBy("seq_id", "block_no").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    # held: the column behind each row's last label; the fold keeps them and each label's row.
    start = F.struct(F.array().cast("array<bigint>").alias("held"), F.array().cast("array<int>").alias("at"))

    def placed(state, x):
        free = F.array_position(F.transform(state["held"], lambda end: end < x["col"]), True).cast("int")
        end = x["col"] + F.length(x["pat"])
        held = F.when(free == 0, F.array_append(state["held"], end)).otherwise(F.transform(state["held"], lambda old, k: F.when(k + 1 == free, end).otherwise(old)))
        return F.struct(held.alias("held"), F.array_append(state["at"], F.when(free == 0, F.size(state["held"]) + 1).otherwise(free)).alias("at"))

    rows = lines.select("seq_id", "block_no", F.explode(F.arrays_zip("xs", F.aggregate("xs", start, placed)["at"].alias("at"))).alias("z"))
    return rows.select("seq_id", "block_no", F.col("z.at").cast("long").alias("label_row"), "z.xs.col", "z.xs.pat", "z.xs.site")


def label_lines(layout: DataFrame) -> DataFrame:
    """The layout as text: seq_id, block_no, label_row, text."""
    rows = layout.groupBy("seq_id", "block_no", "label_row").agg(F.array_sort(F.collect_list(F.struct("col", "pat"))).alias("xs"))
    return rows.select("seq_id", "block_no", "label_row", F.aggregate("xs", F.lit(""), lambda text, x: F.concat(F.rpad(text, x["col"].cast("int"), " "), x["pat"])).alias("text"))


def degenerate_runs(seqs: DataFrame, chunk: int = 1 << 17) -> DataFrame:
    """Start and end of every run of letters other than acgt.

    Runs are found in chunks; those that touch a chunk's edge (at most two of a chunk) are joined where one ends just
    before the next.
    """
    pieces = chunked(seqs, 0, chunk=chunk).select("seq_id", F.col("base").cast("long").alias("base"), F.col("own").cast("long").alias("own"), F.split(F.concat(F.lit("a"), F.col("piece")), "(?<=[acgt])(?=[^acgt])").alias("parts"))
    rows = pieces.select("seq_id", "base", "own", F.posexplode("parts").alias("k", "part"))
    end = F.sum(F.length("part")).over(Window.partitionBy("seq_id", "base").orderBy("k"))
    rows = rows.withColumn("start", (end - F.length("part")).cast("long")).where("k > 0")  # from 1 in the chunk, for the letter put in front
    stop = F.col("start") + F.length(F.regexp_extract("part", "^[^acgt]+", 0)) - 1
    runs = rows.select("seq_id", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + stop).alias("end"), ((F.col("start") == 1) | (stop == F.col("own"))).alias("_edge"))
    by = Window.partitionBy("seq_id").orderBy("start")
    edge = runs.where("_edge").withColumn("_new", F.coalesce(F.lag("end").over(by) + 1 != F.col("start"), F.lit(True)).cast("int"))
    edge = edge.withColumn("_run", F.sum("_new").over(by)).groupBy("seq_id", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.where("NOT _edge").select("seq_id", "start", "end").unionByName(edge.select("seq_id", "start", "end"))
