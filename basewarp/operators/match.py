"""Matching: sequences against sites, regular expressions and weight matrices, both strands.

Sites are found in Arrow batches with array look-ups (scan.py), expressions by automata
(automaton.py) or, where one would be too large, inside the JVM by splitting the sequence before every match
(a zero-width lookahead); either way overlapping
matches count, and only hits become rows, never bases.  Long sequences are first cut into
chunks that overlap by the longest pattern less one base; a hit belongs to the chunk in which
it starts, so none is lost or doubled.  Sequences are rows (seq_id, seq) or come in parts (parts.py).
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import iupac_regex
from ..plans.patterns import Pattern
from .automaton import CODE, TWIN, Automaton, automaton
from .parts import cut, is_parts, twin

#: Bases of a chunk.
CHUNK = 8192
MODES = ("plain", "key", "subset", "overlap")
#: Patterns from which find_sites looks up seeds instead of scanning for each pattern.
MANY = 64


def chunked(seqs: DataFrame, overlap: int, circular: bool = False, chunk: int = CHUNK) -> DataFrame:
    """seq_id, seq_len, base (bases before the chunk), own (starts that belong to it), piece.

    seqs has a row per sequence (seq_id, seq) or parts of sequences (parts.py).  Pieces are sliced from bytes: a slice of a string would count characters from its start each time,
    which grows with the square of a chromosome's length.
    """
    if is_parts(seqs):
        return cut(seqs, overlap, chunk, circular)
    s = F.col("seq")
    text = F.concat(s, F.substring(s, 1, overlap)) if circular else s
    df = seqs.select("seq_id", F.length("seq").cast("long").alias("seq_len"), text.cast("binary").alias("_bytes")).where("seq_len > 0")
    starts = F.sequence(F.lit(0), F.col("seq_len").cast("int") - 1, F.lit(chunk))
    df = df.select("seq_id", "seq_len", "_bytes", F.explode(starts).alias("base"))
    piece = F.substring("_bytes", F.col("base") + 1, F.lit(chunk + overlap)).cast("string")
    return df.select("seq_id", "seq_len", "base", F.least(F.lit(chunk), F.col("seq_len").cast("int") - F.col("base")).alias("own"), piece.alias("piece"))


def starts_of(piece: Column, regex: str) -> Column:
    """Array of the starts (from 1) of all matches, overlapping ones too.

    A mark in front keeps a match at the very start from being lost; each part's end is the next
    match's start.
    """
    parts = F.split(F.concat(F.lit("#"), piece), f"(?={regex})")

    def ends(parts: Column) -> Column:
        return F.aggregate(
            F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
            lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.concat(a["all"], F.array(a["at"] + F.length(p))).alias("all")),
        )["all"]

    return F.get(F.transform(F.array(parts), ends), F.lit(0))  # bound once, so the text is split once


def _scan(seqs: DataFrame, jobs: list[tuple], longest: int, circular: bool, chunk: int = CHUNK) -> DataFrame:
    """jobs: (name, strand, regex, length, shift).  seq_id, seq_len, pat, strand, start, site; not yet filtered to the sequence."""
    pieces = chunked(seqs, longest - 1, circular, chunk)
    # One row per chunk and pattern that has hits; starts stay an array until then.
    found = pieces.select(
        "seq_id",
        "seq_len",
        "base",
        "own",
        F.explode(F.array(*[F.struct(F.lit(name).alias("pat"), F.lit(strand).alias("strand"), F.lit(shift).alias("shift"), starts_of(F.col("piece"), regex).alias("starts")) for name, strand, regex, _, shift in jobs])).alias("h"),
    ).where(F.size("h.starts") > 0)
    hits = found.select("seq_id", "seq_len", "base", "own", "h.pat", "h.strand", "h.shift", F.explode("h.starts").alias("s")).where("s <= own")
    start = (F.col("base") + F.col("s")).cast("long")
    return hits.select("seq_id", "seq_len", "pat", F.col("strand").cast("int").alias("strand"), start.alias("start"), (start + F.col("shift")).cast("long").alias("site"))


def in_sequence(hits: DataFrame, circular: bool = False) -> DataFrame:
    """Coordinates inside the sequence; on a circle they wrap."""
    if circular:
        return hits.withColumn("site", F.pmod(F.col("site") - 1, F.col("seq_len")) + 1)
    return hits.where("site BETWEEN 1 AND seq_len")


def _located(seqs: DataFrame, jobs: list[tuple[str, int, int]], longest: int, circular: bool, find) -> DataFrame:
    """jobs: (name, strand, shift).  find(column, own) yields (jobs, rows, starts) of an Arrow batch's pieces."""
    pieces = chunked(seqs, longest - 1, circular).select("seq_id", "seq_len", "base", "own", "piece")
    kind = pieces.schema["seq_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = pa.array([j[0] for j in jobs], type=pa.string())
        strands, shifts = np.array([j[1] for j in jobs], dtype=np.int32), np.array([j[2] for j in jobs], dtype=np.int64)
        for b in batches:
            own, base = b.column("own").to_numpy(), b.column("base").to_numpy().astype(np.int64)
            for job, row, start in find(b.column("piece"), own):
                job = np.broadcast_to(job, row.shape)
                start, at = base[row] + start, pa.array(row)
                columns = [b.column("seq_id").take(at), b.column("seq_len").take(at), names.take(pa.array(job)), pa.array(strands[job]), pa.array(start), pa.array(start + shifts[job])]
                yield pa.RecordBatch.from_arrays(columns, names=["seq_id", "seq_len", "pat", "strand", "start", "site"])

    return pieces.mapInArrow(run, f"seq_id {kind}, seq_len long, pat string, strand int, start long, site long")


def find_sites(seqs: DataFrame, patterns: list[Pattern], mode: str = "plain", circular: bool = False, seeds: bool | None = None) -> DataFrame:
    """All hits: seq_id, seq_len, pat, strand (1, -1), start (from 1), site (the coordinate of the cut).

    mode: for degenerate targets.  plain: they match nothing; key: as subset, but nothing in a site's most telling six
    places; subset: a letter matches if all its bases do (a sequence of acgt has the hits of plain); overlap: if one
    does.  No patterns give no hits.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if seeds is None:
        seeds = len(patterns) > MANY and mode == "plain"
    if seeds:
        return in_sequence(find_by_seeds(seqs, patterns, circular), circular)
    jobs = [(p.name, strand, site, p.errors, shift) for p in patterns for strand, site, shift in p.strands()]

    def find(column, own):
        from .scan import Site, find

        return find(column, [Site(site, errors, mode) for _, _, site, errors, _ in jobs], own)

    longest = max((p.length for p in patterns), default=1)
    return in_sequence(_located(seqs, [(name, strand, shift) for name, strand, _, _, shift in jobs], longest, circular, find), circular)


def find_by_seeds(seqs: DataFrame, patterns: list[Pattern], circular: bool = False, width: int = 6) -> DataFrame:
    """The same hits for many patterns: each place's word is looked up once in an index of the patterns' words, and only the
    sites found there are compared.

    A pattern without errors is in the index by its most telling word.  One with e errors is cut into e + 1 stretches, of
    which a hit has one without error, and is in it by a word of each; patterns too short for that are counted at every place.
    """
    jobs = [(p.name, strand, site, p.errors, shift) for p in patterns for strand, site, shift in p.strands()]
    ready: list = []  # a task's indexes

    def prepared():
        import numpy as np

        from ..functions.sequence import expand
        from ..plans.patterns import best_seed
        from .scan import SeedIndex, Site, error_seeds, find, find_by_index, find_by_pieces

        for way in (find_by_index, find_by_pieces, find):
            some, keys = [], {}
            for k, (_, _, site, errors, _) in enumerate(jobs):
                seeds = [best_seed(site, min(width, len(site)))] if not errors else error_seeds(site, errors, width)
                if way is (find_by_index if not errors else find_by_pieces if seeds else find):
                    for at, word in seeds:
                        for plain in expand(word):
                            keys.setdefault(len(word), []).append((plain, len(some), at))  # by the word's width: sites shorter than a seed have their own
                    some.append(k)
            if some:
                sites, number = [Site(jobs[k][2], jobs[k][3], "plain") for k in some], np.array(some)
                yield way, number, (sites,) if way is find else (sites, [SeedIndex(words, w) for w, words in keys.items()])

    def find(column, own):
        if not ready:
            ready.extend(prepared())
        for way, number, having in ready:
            for job, row, start in way(column, *having, own):
                yield number[job], row, start

    longest = max((p.length for p in patterns), default=1)
    return _located(seqs, [(name, strand, shift) for name, strand, _, _, shift in jobs], longest, circular, find)


def greatest_length(regex: str) -> int | None:
    """Most bases that a match can take or look at; None where that has no bound or is not known."""
    if re.search(r"[\^$]|\(\?[=!<]|\\[^acgtnds]", re.sub(r"\[\^", "[", regex)):  # anchors, looks around, references
        return None
    try:
        width = int(re._parser.parse(regex).getwidth()[1])
    except (re.error, OverflowError, RecursionError):
        return None
    return width if width <= CHUNK else None


def _entries(pieces: DataFrame, machines: list[Automaton]) -> DataFrame:
    """_seq, _base, entry: the states of all machines right of every chunk, then of their twins left of it.

    A chunk's summary has a number for each state; a sequence's summaries (not its bases) meet in one group, where they are
    composed from right to left and, for the other strand, from left to right.
    """
    kind = pieces.schema["seq_id"].dataType.simpleString()
    sizes = [len(m.table) for m in machines]

    def summaries(batches):
        import numpy as np
        import pyarrow as pa

        from .scan import letters

        for b in batches:
            data, offsets = letters(b.column("piece"))
            codes = CODE[data]
            out = []
            for a, z in zip(offsets.tolist(), offsets[1:].tolist()):
                ways = codes[a:z], TWIN[codes[a:z]][::-1]
                out.append(np.concatenate([m.leaves(way) for way in ways for m in machines]).astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("seq_id"), b.column("base"), pa.array(out, type=pa.binary())], names=["seq_id", "base", "leaves"])

    def composed(group):
        import numpy as np

        group = group.sort_values("base", ignore_index=True)
        begin, k = np.cumsum([0, *sizes[:-1]]), len(sizes)
        out = np.zeros((len(group), 2 * k), dtype=np.int16)
        leaves = [np.frombuffer(x, dtype=np.int16) for x in group["leaves"]]
        for at in range(len(group) - 1, 0, -1):
            out[at - 1, :k] = leaves[at][begin + out[at, :k]]
        for at in range(len(group) - 1):
            out[at + 1, k:] = leaves[at][sum(sizes) + begin + out[at, k:]]
        return group[["seq_id", "base"]].rename(columns={"seq_id": "_seq", "base": "_base"}).assign(entry=[x.tobytes() for x in out])

    return pieces.select("seq_id", "base", "piece").mapInArrow(summaries, f"seq_id {kind}, base long, leaves binary").groupBy("seq_id").applyInPandas(composed, f"_seq {kind}, _base long, entry binary")


def _by_automata(seqs: DataFrame, jobs: list[tuple[str, Automaton]]) -> DataFrame:
    """seq_id, seq_len, pat, strand, start, site of all matches of (name, automaton) on both strands."""
    kind = seqs.schema["seq_id"].dataType.simpleString()
    pieces = chunked(seqs, 0).select("seq_id", "seq_len", F.col("base").cast("long").alias("base"), "piece")
    long = pieces if is_parts(seqs) else pieces.where(F.col("seq_len") > CHUNK)
    met = long.join(_entries(long, [m for _, m in jobs]), F.col("seq_id").eqNullSafe(F.col("_seq")) & (F.col("base") == F.col("_base"))).drop("_seq", "_base")
    # A sequence of one chunk has nothing on either side.
    rows = met if is_parts(seqs) else pieces.where(F.col("seq_len") <= CHUNK).withColumn("entry", F.lit(None).cast("binary")).unionByName(met)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .scan import letters

        names = pa.array([n for n, _ in jobs], type=pa.string())
        for b in batches:
            data, offsets = letters(b.column("piece"))
            codes, base, n = CODE[data], b.column("base").to_numpy(), b.num_rows
            entry = np.array([np.frombuffer(x, dtype=np.int16) if x is not None else np.zeros(2 * len(jobs), dtype=np.int16) for x in b.column("entry").to_pylist()]).reshape(n, 2 * len(jobs))
            below, turned = TWIN[codes][::-1], offsets[-1] - offsets[::-1]
            for k, (_, machine) in enumerate(jobs):
                for strand in (1, -1):
                    if strand == 1:
                        row, place = machine.starts(codes, offsets, entry[:, k])
                        start = base[row] + place + 1
                    else:
                        row, place = machine.starts(below, turned, entry[::-1, len(jobs) + k])
                        row = n - 1 - row
                        start = base[row] + offsets[row + 1] - offsets[row] - place
                    at, start = pa.array(row), pa.array(start)
                    columns = [b.column("seq_id").take(at), b.column("seq_len").take(at), names.take(pa.array(np.full(len(row), k))), pa.array(np.full(len(row), strand, dtype=np.int32)), start, start]
                    yield pa.RecordBatch.from_arrays(columns, names=["seq_id", "seq_len", "pat", "strand", "start", "site"])

    return rows.mapInArrow(run, f"seq_id {kind}, seq_len long, pat string, strand int, start long, site long")


def find_regex(seqs: DataFrame, expressions: list[tuple[str, str]], longest: int = 256) -> DataFrame:
    """Starts of all matches of (name, regular expression with IUPAC letters) on both strands.

    Bottom-strand coordinates are the top-strand place of the match's 5' end.  An expression of letters, classes, groups,
    alternatives and repeats is read as an automaton, in time linear in the bases and over any number of chunks.  One whose
    automaton would be too large (see automaton.py: long counted gaps), or that looks around, is searched for in the JVM: in chunks
    that overlap by longest or, if that is more, by the greatest length of an expression; without one, or with one
    beyond a chunk, in whole sequences.
    """
    known = [(name, iupac_regex(rx)) for name, rx in expressions]
    machines = [(name, m) for name, rx in known if (m := automaton(rx)) is not None]
    jobs = [(name, 1, rx, greatest_length(rx), 0) for name, rx in known if automaton(rx) is None]
    bounded, whole = [j for j in jobs if j[3] is not None], [j for j in jobs if j[3] is None]
    if whole and is_parts(seqs):
        raise ValueError(f"{whole[0][0]}: an expression without bound or automaton needs whole sequences, not parts")

    def scanned(df: DataFrame, strand: int) -> list[DataFrame]:
        ways = [(bounded, max([longest, *(j[3] for j in bounded)]), CHUNK), (whole, 1, 2**31 - 1)]
        return [_scan(df, [(n, strand, rx, m, k) for n, _, rx, m, k in some], most, False, chunk) for some, most, chunk in ways if some]

    below = [x.withColumn("site", F.col("seq_len") - F.col("start") + 1).withColumn("start", F.col("site")) for x in scanned(twin(seqs), -1)]
    return functools.reduce(DataFrame.unionByName, [*([_by_automata(seqs, machines)] if machines else []), *scanned(seqs, 1), *below])


def matrix_scores(counts: list[tuple[float, float, float, float]], cutoff_percent: int) -> tuple[list[list[int]], int]:
    """A count matrix normalised in integer steps (the largest row sum is 1000), and the score that a match needs."""
    top = max(int(100 * sum(r)) for r in counts)
    scaled = [[int(100 * x) * 1000 // top for x in r] for r in counts]
    return scaled, sum(max(r) for r in scaled) * cutoff_percent // 100


def find_matrices(seqs: DataFrame, matrices: list[tuple[str, list[tuple[float, float, float, float]]]], cutoff_percent: int = 85) -> DataFrame:
    """Windows whose summed cell scores reach cutoff_percent of the best possible score, for all (name, counts) in one pass over the
    sequences: seq_id, seq_len, pat, strand, start, site (the window's middle), score.
    """
    kind = seqs.schema["seq_id"].dataType.simpleString()
    jobs = []
    for name, counts in matrices:
        scaled, need = matrix_scores(counts, cutoff_percent)
        jobs += [(name, 1, scaled, need), (name, -1, [r[::-1] for r in scaled[::-1]], need)]  # turned by half a circle

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .scan import Matrix, find_matrices

        tables = [Matrix(rows, need) for _, _, rows, need in jobs]  # half a megabyte each
        names = pa.array([j[0] for j in jobs], type=pa.string())
        for b in batches:
            base = b.column("base").to_numpy().astype(np.int64)
            for job, row, start, score in find_matrices(b.column("piece"), tables, b.column("own").to_numpy()):
                start, at, n = base[row] + start, pa.array(row), len(row)
                columns = [b.column("seq_id").take(at), b.column("seq_len").take(at), names.take(pa.array(np.full(n, job))), pa.array(np.full(n, jobs[job][1], dtype=np.int32)), pa.array(start), pa.array(start + tables[job].length // 2), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["seq_id", "seq_len", "pat", "strand", "start", "site", "score"])

    longest = max((len(counts) for _, counts in matrices), default=1)
    pieces = chunked(seqs, longest - 1).select("seq_id", "seq_len", "base", "own", "piece")
    return pieces.mapInArrow(run, f"seq_id {kind}, seq_len long, pat string, strand int, start long, site long, score long")


def find_matrix(seqs: DataFrame, name: str, counts: list[tuple[float, float, float, float]], cutoff_percent: int = 85) -> DataFrame:
    """The same of one matrix."""
    return find_matrices(seqs, [(name, counts)], cutoff_percent)


def consensus(counts: list[tuple[float, float, float, float]], cutoff_percent: int = 75) -> str:
    """A matrix's IUPAC consensus: the base that alone reaches the cutoff, else the best pair, else triple, else n."""
    import itertools

    from ..functions.sequence import BY_MASK

    out = []
    for row in counts:
        total = sum(row) or 1
        for size in (1, 2, 3):
            best = max(itertools.combinations(range(4), size), key=lambda some: sum(row[j] for j in some))
            if 100 * sum(row[j] for j in best) >= cutoff_percent * total:
                out.append(BY_MASK[sum(1 << j for j in best)])
                break
        else:
            out.append("n")
    return "".join(out)


def nmers(seqs: DataFrame, n: int) -> DataFrame:
    """seq_id, start, nmer of every clean n-mer (2 to 20 bases): a row per base, for those who want the rows themselves."""
    pieces = chunked(seqs, _checked(n) - 1)
    rows = pieces.select("seq_id", "base", "piece", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("s")).select("seq_id", (F.col("base") + F.col("s")).cast("long").alias("start"), F.substring("piece", F.col("s"), F.lit(n)).alias("nmer"))
    return rows.where(F.length("nmer") == n).where(~F.regexp_like("nmer", F.lit("[^acgt]")))


def _checked(n: int) -> int:
    if not 2 <= n <= 20:
        raise ValueError("n-mers have 2 to 20 bases")
    return n


def nmer_counts(seqs: DataFrame, n: int) -> DataFrame:
    """nmer, n: counted in arrays, per task where there are at most 4 ** 10 words and per batch beyond; only counts are shuffled."""
    pieces = chunked(seqs, _checked(n) - 1).select("own", "piece")

    def run(batches):
        import pyarrow as pa

        from .scan import count_words, plain_words

        for words, counts in count_words(batches, n):
            yield pa.RecordBatch.from_arrays([plain_words(words, n), pa.array(counts)], names=["nmer", "n"])

    return pieces.mapInArrow(run, "nmer string, n long").groupBy("nmer").agg(F.sum("n").alias("n"))


def distinct_nmers(seqs: DataFrame, n: int) -> DataFrame:
    """nmer: the distinct words of n IUPAC letters (at most five)."""
    if not 1 <= n <= 5:
        raise ValueError("distinct words have 1 to 5 letters")

    def run(batches):
        import pyarrow as pa

        from .scan import distinct_words

        yield pa.RecordBatch.from_arrays([pa.array(distinct_words(batches, n), type=pa.string())], names=["nmer"])

    return chunked(seqs, n - 1).select("own", "piece").mapInArrow(run, "nmer string").distinct()
