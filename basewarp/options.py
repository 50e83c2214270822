"""The options of a search, passed explicitly, and the search itself as a set of lazy tables."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import sequence as sq
from .operators import derive, match, orfs, proximity, windows
from .plans.patterns import DAM, DCM, Pattern, passes, select
from .plans.rules import Rule

_matchers: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_matcher(name: str, find: Callable[[DataFrame], DataFrame]) -> None:
    """A user's own matcher: from sequences to hits (seq_id, seq_len, pat, strand, start, site)."""
    _matchers[name] = find


#: The numbered ways with degenerate letters of a sequence: 0 drops them, 1 and 3 match a letter if all its bases match
#: (1 is the default for sequences that may have none), 2 keeps them out of a site's key, 4 matches if any base does.
DEGENERACY = {0: "plain", 1: "subset", 2: "key", 3: "subset", 4: "overlap"}


@dataclasses.dataclass(frozen=True)
class Options:
    # patterns
    patterns: tuple[Pattern, ...] = ()
    names: tuple[str, ...] = ()
    magnitude: float | None = None
    overhang: str | None = None
    overhang_length: int | None = None
    cost: int | None = None
    regexes: tuple[tuple[str, str], ...] = ()
    matrices: tuple[tuple[str, tuple, int], ...] = ()  # name, rows of counts, cutoff in percent
    matchers: tuple[str, ...] = ()
    # sequences
    begin: int = 1
    end: int = 0
    turn: str = ""  # reverse, complement or revcomp
    circular: bool = False
    # matching
    mode: str = "plain"
    degeneracy: int | None = None  # one of DEGENERACY, in place of mode
    silent: bool = False
    dam: bool = False
    dcm: bool = False
    min_hits: int = 1
    max_hits: int = 32000
    # results
    proximity: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    clone: tuple[tuple[int, int, bool], ...] = ()
    bin_size: int = 1000
    extract: tuple[int, int, bool] | None = None  # bases before, bases after, bottom-strand hits turned
    width: int = 60
    gel: tuple[int, int] = (100, 10000)
    codon_table: int = 0
    orf_min: int = 30
    orf_frames: tuple[int, ...] = (1, 2, 3, 4, 5, 6)


def chosen(o: Options) -> list[Pattern]:
    """Named patterns as they are (magnitude and overhang do not apply to them), else those that pass the filters."""
    if o.names:
        return [p for p in select(list(o.patterns), list(o.names)) if passes(p, cost=o.cost)]
    return [p for p in o.patterns if passes(p, o.magnitude, o.overhang, o.overhang_length, o.cost)]


def sequences(seqs: DataFrame, o: Options) -> DataFrame:
    """The part of each sequence, and the way round, that the options ask for."""
    turns = {"": lambda c: c, "reverse": sq.reverse, "complement": sq.complement, "revcomp": sq.reverse_complement}
    if o.turn not in turns:
        raise ValueError(f"unknown turn {o.turn!r}")
    seq = F.col("seq")
    if (o.begin, o.end) != (1, 0):
        seq = sq.subsequence(seq, o.begin, o.end)
    if o.degeneracy == 0:
        seq = F.regexp_replace(seq, "[^acgt]", "")
    return seqs.withColumn("seq", turns[o.turn](seq))


def search(seqs: DataFrame, o: Options) -> dict[str, DataFrame]:
    """Every table that the options ask for; nothing runs until one is used."""
    own, seqs = chosen(o), sequences(seqs, o)
    mode = o.mode if o.degeneracy is None else DEGENERACY[o.degeneracy]
    target = orfs.silent(seqs, o.codon_table) if o.silent else seqs
    hits = match.find_sites(target, own, "subset" if o.silent else mode, o.circular)
    names = [p.name for p in own]
    if o.regexes:
        hits = hits.unionByName(match.find_regex(target, list(o.regexes)).select(hits.columns))
        names += [n for n, _ in o.regexes]
    for name, counts, cutoff in o.matrices:
        hits = hits.unionByName(match.find_matrix(target, name, list(counts), cutoff).select(hits.columns))
        names.append(name)
    for name in o.matchers:
        hits = hits.unionByName(_matchers[name](seqs))
    for on, methylase, kind in ((o.dam, DAM, "dam"), (o.dcm, DCM, "dcm")):
        if on:
            hits = derive.masked(hits, match.find_sites(target, [methylase], mode, o.circular), own, kind)
    sites = derive.distinct_sites(hits)
    counted = derive.between_own_hits(sites, own, o.min_hits, o.max_hits)
    sites = sites.join(counted.select("seq_id", "pat"), ["seq_id", "pat"], "left_semi")
    frags = derive.fragments(sites, o.circular)
    composed = seqs.where("seq <> ''").select("seq_id", F.length("seq").alias("n"), *[(sq.count_of("seq", b) / F.length("seq")).alias(f"f_{b}") for b in "acgt"])
    chances = F.array(*[F.struct(F.lit(p.name).alias("pat"), sq.expected_sites(p.site, [F.col(f"f_{b}") for b in "acgt"], F.col("n")).alias("expected")) for p in own]).cast("array<struct<pat:string,expected:double>>")
    out = {
        "hits": hits,
        "sites": sites,
        "counts": counted,
        "summary": derive.pattern_summary(sites),
        "zero": derive.pattern_names(sites, names).join(sites.select("pat").distinct(), "pat", "left_anti"),
        "expected": composed.select("seq_id", F.explode(chances).alias("e")).select("seq_id", "e.pat", "e.expected"),
        "order": derive.strider_order(sites),
        "site list": derive.sites_table(sites),
        "fragments": frags,
        "combined": derive.fragments(derive.combined(sites), o.circular),
        "bins": derive.binned(sites, o.bin_size),
        "linear map": derive.linear_map(seqs, sites, o.width),
        "ladder": derive.ladder_cells(sites, o.width),
        "few cutters": derive.few_cutters(sites),
        "gel": derive.gel_cells(frags, o.width, *o.gel),
        "plasmid": derive.plasmid_angles(sites),
        "degenerate runs": derive.degenerate_runs(seqs),
        "translation": orfs.frames(seqs, o.orf_frames, o.codon_table),
        "starts and stops": orfs.starts_and_stops(seqs, o.orf_frames, o.codon_table),
        "orfs": orfs.orfs(seqs, o.orf_min, o.orf_frames, o.codon_table),
    }
    if o.extract:
        out["extract"] = derive.extract(seqs, hits, *o.extract)
    for text in o.proximity:
        out[f"proximity {text}"] = proximity.near(sites, text)
    for rule in o.rules:
        out[f"rule {rule.name}"] = windows.rule_windows(sites, rule)
    if o.clone:
        out["clone"] = derive.clone_ranges(sites, list(o.clone))
        out["clone ladder"] = derive.clone_ladder(sites, list(o.clone), o.width)
    return out
