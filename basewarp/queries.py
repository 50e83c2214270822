"""Registered queries of the engine, each with DuckDB SQL over the same tables.

Documents are the sequences: any text is a sequence once everything but the letters is
dropped.  ``SEQ`` keeps acgt, ``IUPAC_SEQ`` all fifteen letters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .functions import codons as cod
from .functions import sequence as sq
from .operators import derive, match, orfs, proximity, windows
from .operators.parts import cut, join_parts
from .plans import patterns as pt
from .plans.rules import bounded, parse_rule
from .sources import files, split
from .sources.sequences import from_text, read_sequences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DEMO = pt.DEMO
NAMED = {p.name: p for p in DEMO}
SOME = [NAMED[n] for n in ("HinfI", "TaqI", "RsaI", "MboI", "EcoRI", "BsmAI")]
FEW = [NAMED[n] for n in ("HinfI", "TaqI", "RsaI")]


def sequences(spark: SparkSession, sf_dir: str, degenerate: bool = False) -> DataFrame:
    return from_text(spark.read.parquet(f"{sf_dir}/documents.parquet"), degenerate)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# ------------------------------------------------------------------ SQL parts

SEQ = "seqs AS (SELECT doc_id AS seq_id, regexp_replace(translate(text, 'ACGTUu', 'acgttt'), '[^acgt]', '', 'g') AS seq FROM documents)"
IUPAC_SEQ = "seqs AS (SELECT doc_id AS seq_id, regexp_replace(translate(text, 'ACGTRYWSKMBDHVNUu', 'acgtrywskmbdhvntt'), '[^acgtrywskmbdhvn]', '', 'g') AS seq FROM documents)"
COMPLEMENT = "translate({}, 'acgtrymkbdhvwsn', 'tgcayrkmvhdbwsn')"
REVCOMP = f"reverse({COMPLEMENT})"

# Written out by hand, not made by the pattern compiler: strand, expression on the top strand, its length, and
# the coordinate less the match's start.
FIXED = {
    "HinfI": [(1, "ga[acgt]tc", 5, 1)],
    "TaqI": [(1, "tcga", 4, 1)],
    "RsaI": [(1, "gtac", 4, 2)],
    "MseI": [(1, "ttaa", 4, 1)],
    "EcoRI": [(1, "gaattc", 6, 1)],
    "AluI": [(1, "agct", 4, 2)],
    "HaeIII": [(1, "ggcc", 4, 2)],
    "MboI": [(1, "gatc", 4, 0)],
    "NlaIII": [(1, "catg", 4, 4)],
    "BsmAI": [(1, "gtctc", 5, 6), (-1, "gagac", 5, -5)],
    "BsmAI2": [(1, "gtctc", 5, 6), (-1, "gagac", 5, -5)],
    "HindIII": [(1, "aagctt", 6, 1)],
    "ccg": [(1, "ccg", 3, 1), (-1, "cgg", 3, 2)],
    "dam": [(1, "gatc", 4, 0)],
    "dcm": [(1, "cc[at]gg", 5, 0)],
    "rgcy": [(1, "[ag]gc[ct]", 4, 0)],
    "gantc": [(1, "ga[acgt]tc", 5, 0)],
    "ccwgg": [(1, "cc[at]gg", 5, 0)],
}
# The same for degenerate targets: letters whose bases are all allowed, letters that share a base, and plain
# letters in the six most telling places.
FIXED_SUBSET = {
    "HinfI": [(1, "ga[acgtrywskmbdhvn]tc", 5, 1)],
    "BsmAI": [(1, "gtctc", 5, 6), (-1, "gagac", 5, -5)],
    "rgcy": [(1, "[agr]gc[cty]", 4, 0)],
}
FIXED_OVERLAP = {
    "HinfI": [(1, "[grskbdvn][arwmdhvn][acgtrywskmbdhvn][tywkbdhn][cysmbhvn]", 5, 1)],
    "BsmAI": [(1, "[grskbdvn][tywkbdhn][cysmbhvn][tywkbdhn][cysmbhvn]", 5, 6), (-1, "[grskbdvn][arwmdhvn][grskbdvn][arwmdhvn][cysmbhvn]", 5, -5)],
    "rgcy": [(1, "[agrwskmbdhvn][grskbdvn][cysmbhvn][ctywskmbdhvn]", 4, 0)],
}
FIXED_KEY = {"rgcnnnnya": [(1, "[ag]gc[acgt][acgt][acgt][acgtrywskmbdhvn][cty]a", 9, 0), (-1, "t[agr][acgtrywskmbdhvn][acgt][acgt][acgt]gc[ct]", 9, 9)]}
_FIXED = {"plain": FIXED, "subset": FIXED_SUBSET, "overlap": FIXED_OVERLAP, "key": FIXED_KEY}


def hits_sql(patterns: list, mode: str = "plain", circular: bool = False) -> str:
    """CTE hits: seq_id, seq_len, pat, strand, start, site; every position is tried.  patterns: names, or patterns by their names."""
    parts = []
    for name in (p if isinstance(p, str) else p.name for p in patterns):
        for strand, rx, n, shift in _FIXED[mode][name]:
            text = f"seq || substr(seq, 1, {n - 1})" if circular else "seq"
            count = "length(seq)" if circular else f"length(seq) - {n} + 1"
            at = f"((p + {shift} - 1) % length(seq) + length(seq)) % length(seq) + 1" if circular else f"p + {shift}"
            ok = "true" if circular else f"p + {shift} BETWEEN 1 AND length(seq)"
            parts.append(f"SELECT seq_id, length(seq) AS seq_len, '{name}' AS pat, {strand} AS strand, p AS start, {at} AS site FROM seqs, unnest(range(1, {count} + 1)) AS t(p) WHERE length(seq) > 0 AND {ok} AND regexp_full_match(substr({text}, p, {n}), '{rx}')")
    return "hits AS (" + " UNION ALL ".join(parts) + "), sites AS (SELECT seq_id, seq_len, pat, site, max(strand) AS strand FROM hits GROUP BY ALL)"


def with_hits(patterns: list, body: str, mode: str = "plain", seq: str = SEQ, circular: bool = False) -> str:
    return f"WITH {seq}, {hits_sql(patterns, mode, circular)} {body}"


def hits(spark: SparkSession, sf_dir: str, patterns: list[pt.Pattern], **more) -> DataFrame:
    return match.find_sites(sequences(spark, sf_dir), patterns, **more)


def sites(spark: SparkSession, sf_dir: str, patterns: list[pt.Pattern], **more) -> DataFrame:
    return derive.distinct_sites(hits(spark, sf_dir, patterns, **more))


# ------------------------------------------------------- sequence functions


@query(
    "base_composition",
    f"WITH {SEQ}, n AS (SELECT seq_id, length(seq) AS seq_len, "
    + ", ".join(f"length(seq) - length(replace(seq, '{b}', '')) AS n_{b}" for b in "acgt")
    + " FROM seqs) SELECT *, CASE WHEN seq_len > 0 THEN (n_g + n_c) * 1000000 // seq_len ELSE 0 END AS gc_ppm FROM n",
)
def base_composition(spark, sf_dir):
    s = sequences(spark, sf_dir).select("seq_id", F.length("seq").cast("long").alias("seq_len"), *[sq.count_of("seq", b).alias(f"n_{b}") for b in "acgt"])
    return s.withColumn("gc_ppm", F.when(F.col("seq_len") > 0, F.expr("(n_g + n_c) * 1000000 div seq_len")).otherwise(F.lit(0).cast("long")))


@query("degenerate_composition", f"WITH {IUPAC_SEQ} SELECT seq_id, " + ", ".join(f"length(seq) - length(replace(seq, '{b}', '')) AS n_{b}" for b in sq.LETTERS) + " FROM seqs")
def degenerate_composition(spark, sf_dir):
    return sequences(spark, sf_dir, True).select("seq_id", *[sq.count_of("seq", b).alias(f"n_{b}") for b in sq.LETTERS])


for _name, _f, _sql in (("revcomp", sq.reverse_complement, REVCOMP), ("complement", sq.complement, COMPLEMENT), ("reverse", sq.reverse, "reverse({})")):

    def _turn(spark, sf_dir, f=_f):
        return sequences(spark, sf_dir, True).select("seq_id", f("seq").alias("seq"))

    query(_name, f"WITH {IUPAC_SEQ} SELECT seq_id, {_sql.format('seq')} AS seq FROM seqs")(_turn)


@query("triplet_reverse", f"WITH {SEQ} SELECT seq_id, coalesce(array_to_string(list_reverse(regexp_extract_all(seq, '(...)', 1)), ''), '') AS seq FROM seqs")
def triplet_reverse(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", sq.triplet_reverse("seq").alias("seq"))


_FOLD = {"acgt": (1.0, 1), "rywskm": (0.5, 2), "bdhv": (0.25, 3), "n": (0.0, 4)}
_count = lambda letters: f"length(regexp_replace(w, '[^{letters}]', '', 'g'))"


@query(
    "nmer_properties",
    f"WITH {IUPAC_SEQ}, w AS (SELECT DISTINCT substr(seq, p, 4) AS w FROM seqs, unnest(range(1, length(seq) - 2)) AS t(p)) SELECT w AS nmer, w = {REVCOMP.format('w')} AS palindrome, ("
    + " + ".join(f"{_count(x)} * {m}" for x, (m, _) in _FOLD.items())
    + ")::DOUBLE AS magnitude, CAST("
    + " * ".join(f"power({d}, {_count(x)})" for x, (_, d) in _FOLD.items())
    + " AS BIGINT) AS degeneracy, CASE WHEN regexp_full_match(w, '[acgt]+') THEN "
    + " + ".join(f"(strpos('acgt', substr(w, {i + 1}, 1)) - 1) * {4**i}" for i in range(4))
    + " ELSE 0 END AS key FROM w",
)
def nmer_properties(spark, sf_dir):
    w = match.distinct_nmers(sequences(spark, sf_dir, True), 4).withColumnRenamed("nmer", "w")
    return w.select(F.col("w").alias("nmer"), sq.is_palindrome("w").alias("palindrome"), sq.magnitude("w").alias("magnitude"), sq.degeneracy("w").alias("degeneracy"), sq.nmer_key("w").alias("key"))


@query(
    "degen_runs",
    f"""WITH {IUPAC_SEQ}, c AS (SELECT seq_id, p FROM seqs, unnest(range(1, length(seq) + 1)) AS t(p) WHERE NOT regexp_matches(substr(seq, p, 1), '[acgt]')),
g AS (SELECT seq_id, p, p - row_number() OVER (PARTITION BY seq_id ORDER BY p) AS k FROM c)
SELECT seq_id, min(p) AS start, max(p) AS "end" FROM g GROUP BY seq_id, k""",
)
def degen_runs(spark, sf_dir):
    return derive.degenerate_runs(sequences(spark, sf_dir, True))


@query("subsequence", f"WITH {SEQ.replace('translate(text', 'translate(substr(text, 101, 400)')} SELECT seq_id, seq FROM seqs")
def subsequence(spark, sf_dir):
    return from_text(spark.read.parquet(f"{sf_dir}/documents.parquet"), False, 101, 500)


@query("kmer_counts", f"WITH {SEQ} SELECT substr(seq, p, 5) AS nmer, count(*) AS n FROM seqs, unnest(range(1, length(seq) - 3)) AS t(p) GROUP BY 1")
def kmer_counts(spark, sf_dir):
    return match.nmer_counts(sequences(spark, sf_dir), 5)


_ANY = "(f_a + f_c + f_g + f_t)"
# FEW's sites are their own twins, so each counts twice.
_CHANCE = {"HinfI": f"f_g * f_a * {_ANY} * f_t * f_c", "TaqI": "f_t * f_c * f_g * f_a", "RsaI": "f_g * f_t * f_a * f_c"}


@query(
    "expected_hits",
    f"WITH {SEQ}, f AS (SELECT seq_id, length(seq) AS n, "
    + ", ".join(f"(length(seq) - length(replace(seq, '{b}', ''))) / CAST(length(seq) AS DOUBLE) AS f_{b}" for b in "acgt")
    + " FROM seqs WHERE length(seq) > 0) "
    + " UNION ALL ".join(f"SELECT seq_id, '{pat}' AS pat, round(({chance} + {chance}) * n, 6) AS expected FROM f" for pat, chance in _CHANCE.items()),
)
def expected_hits(spark, sf_dir):
    s = sequences(spark, sf_dir).where("seq <> ''").select("seq_id", F.length("seq").alias("n"), *[(sq.count_of("seq", b) / F.length("seq")).alias(f"f_{b}") for b in "acgt"])
    each = F.array(*[F.struct(F.lit(p.name).alias("pat"), F.round(sq.expected_sites(p.site, [F.col(f"f_{b}") for b in "acgt"], F.col("n")), 6).alias("expected")) for p in FEW])
    return s.select("seq_id", F.explode(each).alias("e")).select("seq_id", "e.pat", "e.expected")


# ------------------------------------------------------------------ patterns

_KEYS = [p for p in DEMO]


_DEMO_ROWS = """('HinfI', 'gantc', 1, 3, 10000, 100), ('TaqI', 'tcga', 1, 2, 4000, 50), ('RsaI', 'gtac', 2, 0, 1000, 40), ('MseI', 'ttaa', 1, 2, 500, 60), ('EcoRI', 'gaattc', 1, 4, 10000, 50),
('AluI', 'agct', 2, 0, 500, 50), ('HaeIII', 'ggcc', 2, 0, 3000, 45), ('MboI', 'gatc', 0, 4, 500, 50), ('NlaIII', 'catg', 4, -4, 500, 55), ('BsmAI', 'gtctc', 6, 4, 1000, 50), ('HindIII', 'aagctt', 1, 4, 10000, 50)"""


@query(
    "pattern_table",
    with_hits(DEMO, f"SELECT pat, site, {REVCOMP.format('site')} AS twin, CAST(length(site) AS INT) AS length, top_cut, overhang, site = {REVCOMP.format('site')} AS palindrome, CAST(length(replace(site, 'n', '')) AS DOUBLE) AS magnitude, CAST(units // price AS INT) AS cost, rpad(site, 6, 'n') AS seed, (SELECT count(*) FROM sites s WHERE s.pat = v.pat) AS n_hits FROM (VALUES {_DEMO_ROWS}) v(pat, site, top_cut, overhang, units, price)"),
)
def pattern_table(spark, sf_dir):
    """The patterns with what the compiler makes of them, and their sites in the documents."""
    rows = [(p.name, p.site, p.length, p.top_cut, p.overhang, p.units, p.price, pt.best_seed(p.site)[1]) for p in DEMO]
    df = spark.createDataFrame(rows, "pat string, site string, length int, top_cut int, overhang int, units int, price int, seed string")
    cost = F.when(F.col("price") > 0, F.floor(F.col("units") / F.col("price"))).otherwise(0).cast("int")
    found = derive.pattern_summary(sites(spark, sf_dir, DEMO)).select("pat", "n_hits")
    df = df.join(found, "pat", "left")
    return df.select("pat", "site", sq.reverse_complement("site").alias("twin"), "length", "top_cut", "overhang", sq.is_palindrome("site").alias("palindrome"), sq.magnitude("site").alias("magnitude"), cost.alias("cost"), "seed", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def _filtered(name: str, left: list[str], **how):
    """left: the patterns that pass, worked out by hand."""

    def run(spark, sf_dir):
        return derive.pattern_summary(sites(spark, sf_dir, [p for p in DEMO if pt.passes(p, **how)])).select("pat", "n_hits")

    query(name, with_hits(left, "SELECT pat, count(*) AS n_hits FROM sites GROUP BY pat"))(run)


_filtered("magnitude_filter", ["EcoRI", "BsmAI", "HindIII"], magnitude=5)
_filtered("overhang_filter", ["EcoRI", "MboI", "BsmAI", "HindIII"], overhang="5", overhang_length=4)
_filtered("blunt_filter", ["RsaI", "AluI", "HaeIII"], overhang="0")
_filtered("cost_filter", ["HinfI", "TaqI", "EcoRI", "HaeIII", "HindIII"], cost=40)


@query("name_selection", with_hits(["TaqI", "RsaI"], "SELECT pat, count(*) AS n_hits FROM sites GROUP BY pat"))
def name_selection(spark, sf_dir):
    return derive.pattern_summary(sites(spark, sf_dir, pt.select(DEMO, ["taqi", "RSAI"]))).select("pat", "n_hits")


# ------------------------------------------------------------------- matching


@query("iupac_sites", with_hits([pt.Pattern("rgcy", "rgcy"), pt.Pattern("gantc", "gantc"), pt.Pattern("ccwgg", "ccwgg")], "SELECT seq_id, pat, start FROM hits"))
def iupac_sites(spark, sf_dir):
    return hits(spark, sf_dir, [pt.Pattern("rgcy", "rgcy"), pt.Pattern("gantc", "gantc"), pt.Pattern("ccwgg", "ccwgg")]).select("seq_id", "pat", "start")


@query("both_strand_sites", with_hits(SOME, "SELECT seq_id, pat, strand, start, site FROM hits"))
def both_strand_sites(spark, sf_dir):
    return hits(spark, sf_dir, SOME).select("seq_id", "pat", "strand", "start", "site")


@query("seed_join_sites", with_hits(SOME, "SELECT seq_id, pat, strand, start, site FROM hits"))
def seed_join_sites(spark, sf_dir):
    return hits(spark, sf_dir, SOME, seeds=True).select("seq_id", "pat", "strand", "start", "site")


for _n in (1, 2):
    _p = [pt.Pattern("test", "gaattc", errors=_n), pt.Pattern("odd", "gtctcga", errors=_n)]

    def _errors(spark, sf_dir, p=_p):
        return hits(spark, sf_dir, p).select("seq_id", "pat", "strand", "start")

    # Counted differing positions, not variants.
    _parts = []
    for _name, _strand, _site, _shift in (("test", 1, "gaattc", 0), ("odd", 1, "gtctcga", 0), ("odd", -1, "tcgagac", 7)):
        _differ = " + ".join(f"CAST(substr(seq, p + {i}, 1) <> '{b}' AS INT)" for i, b in enumerate(_site))
        _parts.append(f"SELECT seq_id, '{_name}' AS pat, {_strand} AS strand, p AS start FROM seqs, unnest(range(1, length(seq) - {len(_site)} + 2)) AS t(p) WHERE {_differ} <= {_n} AND p + {_shift} <= length(seq)")
    query(f"mismatch_sites_{_n}", f"WITH {SEQ} " + " UNION ALL ".join(_parts))(_errors)


for _mode in ("subset", "overlap"):

    def _degenerate(spark, sf_dir, mode=_mode):
        return match.find_sites(sequences(spark, sf_dir, True), [NAMED["HinfI"], NAMED["BsmAI"], pt.Pattern("rgcy", "rgcy")], mode=mode).select("seq_id", "pat", "strand", "start", "site")

    query(f"degenerate_{_mode}", with_hits([NAMED["HinfI"], NAMED["BsmAI"], pt.Pattern("rgcy", "rgcy")], "SELECT seq_id, pat, strand, start, site FROM hits", _mode, IUPAC_SEQ))(_degenerate)


@query("degenerate_key", with_hits(["rgcnnnnya"], "SELECT seq_id, pat, strand, start, site FROM hits", "key", IUPAC_SEQ))
def degenerate_key(spark, sf_dir):
    return match.find_sites(sequences(spark, sf_dir, True), [pt.Pattern("rgcnnnnya", "rgcnnnnya")], mode="key").select("seq_id", "pat", "strand", "start", "site")


EXPRESSIONS = [("rx1", "ga(tt|ac)n{1,3}y"), ("rx2", "wt{2,4}ar")]
LONG = [("long", "gaga(n{300,500})ttct")]
_FIXED_EXPRESSIONS = [("rx1", "ga(tt|ac)[acgt]{1,3}[ct]", 64, "ga"), ("rx2", "[at]t{2,4}a[ag]", 64, "")]
_FIXED_LONG = [("long", "gaga[acgt]{300,500}ttct", 508, "gaga")]


def _regex_sql(strand: int, expressions: list[tuple[str, str, int, str]]) -> str:
    """expressions: name, expression, letters that a match takes at most, letters that it begins with."""
    text = "seq" if strand == 1 else REVCOMP.format("seq")
    at = "p" if strand == 1 else "length(seq) - p + 1"
    return " UNION ALL ".join(f"SELECT seq_id, '{n}' AS pat, {strand} AS strand, {at} AS site FROM (SELECT seq_id, seq, {text} AS t FROM seqs), unnest(range(1, length(seq) + 1)) AS u(p) WHERE substr(t, p, {len(first)}) = '{first}' AND regexp_matches(substr(t, p, {most}), '^(?:{rx})')" for n, rx, most, first in expressions)


@query("regex_sites", f"WITH {SEQ} {_regex_sql(1, _FIXED_EXPRESSIONS)} UNION ALL {_regex_sql(-1, _FIXED_EXPRESSIONS)}")
def regex_sites(spark, sf_dir):
    return match.find_regex(sequences(spark, sf_dir), EXPRESSIONS, 64).select("seq_id", "pat", "strand", "site")


_JOINED = f"{SEQ.replace('seqs AS', 'single AS')}, seqs AS (SELECT seq_id // 50 AS seq_id, string_agg(seq, '' ORDER BY seq_id) AS seq FROM single GROUP BY 1)"


@query("regex_long_sites", f"WITH {_JOINED} {_regex_sql(1, _FIXED_LONG)} UNION ALL {_regex_sql(-1, _FIXED_LONG)}")
def regex_long_sites(spark, sf_dir):
    """Long matches in long sequences (fifty documents each), over the edges of chunks."""
    each = sequences(spark, sf_dir).groupBy(F.floor(F.col("seq_id") / 50).cast("long").alias("joined")).agg(F.array_sort(F.collect_list(F.struct("seq_id", "seq"))).alias("parts"))
    long = each.select(F.col("joined").alias("seq_id"), F.array_join(F.transform("parts", lambda x: x["seq"]), "").alias("seq"))
    return match.find_regex(long, LONG).select("seq_id", "pat", "strand", "site")


_GROWING = [("run", "ga+c"), ("mixed", "gg(ac|t)+ta*g{2,}"), ("far", "gaattc.*ggcc")]


def _growing_sql(strand: int) -> str:
    # Where an expression's first letters are is looked for in stretches, as a substring of a long text is counted from its start.
    text = "seq" if strand == 1 else REVCOMP.format("seq")
    at = "p" if strand == 1 else "length(seq) - p + 1"
    parts = []
    for n, rx, first in (("run", "ga+c", "ga"), ("mixed", "gg(ac|t)+ta*g{2,}", "gg"), ("far", "gaattc.*ggcc", "gaattc")):
        near = f"SELECT seq_id, seq, t, 256 * k AS k, substr(t, 256 * k + 1, 264) AS s FROM (SELECT seq_id, seq, {text} AS t FROM seqs), unnest(range(0, length(seq) // 256 + 1)) AS v(k)"
        place = f"SELECT seq_id, seq, t, k + i AS p FROM ({near}), unnest(range(1, 257)) AS u(i) WHERE substr(s, i, {len(first)}) = '{first}'"
        parts.append(f"SELECT seq_id, '{n}' AS pat, {strand} AS strand, {at} AS site FROM ({place}) WHERE regexp_matches(substr(t, p), '^(?:{rx})')")
    return " UNION ALL ".join(parts)


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents each as one sequence in parts."""
    return join_parts(sequences(spark, sf_dir).select(F.floor(F.col("seq_id") / 50).cast("long").alias("seq_id"), F.col("seq_id").alias("part_no"), "seq"))


@query("regex_unbounded", f"WITH {_JOINED} {_growing_sql(1)} UNION ALL {_growing_sql(-1)}")
def regex_unbounded(spark, sf_dir):
    """Expressions whose matches have no greatest length, over sequences that no row holds whole."""
    return match.find_regex(joined(spark, sf_dir), _GROWING).select("seq_id", "pat", "strand", "site")


def _sites_by_rule(n: int) -> list[tuple[str, str]]:
    return [(f"m{k}", "".join("acgt"[(k * k * 7 + i * i * 3 + k * i * 5 + (k + i) // 3) % 4] for i in range(12 + k % 5))) for k in range(n)]


_MANY = [p for k, s in _sites_by_rule(200) for p in [pt.Pattern(k, s, errors=2)]]
# Both strands of each site; of its twelve or more letters three fours are looked for, and one of them has no error.
_MANY_SQL = "many(pat, strand, site) AS (SELECT pat, 1, site FROM (VALUES {0}) v(pat, site) UNION ALL SELECT pat, -1, {1} FROM (VALUES {0}) v(pat, site) WHERE site <> {1})".format(", ".join(f"('{k}', '{s}')" for k, s in _sites_by_rule(200)), REVCOMP.format("site"))


@query(
    "mismatch_many",
    f"""WITH {SEQ}, {_MANY_SQL},
fours AS (SELECT seq_id, seq, p, substr(seq, p, 4) AS w FROM seqs, unnest(range(1, length(seq) - 2)) AS t(p)),
keys AS (SELECT pat, strand, site, o, substr(site, o + 1, 4) AS w FROM many, (VALUES (0), (4), (8)) v(o)),
near AS (SELECT DISTINCT seq_id, pat, strand, site, seq, p - o AS start FROM fours JOIN keys USING (w) WHERE p - o >= 1 AND p - o + length(site) - 1 <= length(seq) AND hamming(substr(seq, p - o, length(site)), site) <= 2)
SELECT pat, strand, count(*) AS n_hits, CAST(sum(start) AS BIGINT) AS start_sum, count(DISTINCT seq_id) AS n_seqs FROM near GROUP BY ALL""",
)
def mismatch_many(spark, sf_dir):
    """200 patterns with two errors each.  Patterns without a cut have coordinate start or, below, start + length, which may lie behind the end."""
    found = match.find_by_seeds(sequences(spark, sf_dir), _MANY)
    return found.groupBy("pat", "strand").agg(F.count(F.lit(1)).alias("n_hits"), F.sum("start").alias("start_sum"), F.count_distinct("seq_id").alias("n_seqs"))


_MATRICES = [(f"x{k}", [tuple(1 + (7 * k + 5 * i + 3 * j * (k + i)) % 13 for j in range(4)) for i in range(6)]) for k in range(50)]


@query(
    "matrix_many",
    f"""WITH {SEQ},
cell AS (SELECT k, i, j, 1 + (7 * k + 5 * i + 3 * j * (k + i)) % 13 AS x FROM range(50) a(k), range(6) b(i), range(4) c(j)),
top AS (SELECT k, max(s) AS top FROM (SELECT k, i, 100 * sum(x) AS s FROM cell GROUP BY k, i) GROUP BY k),
scaled AS (SELECT k, i, substr('acgt', j + 1, 1) AS b, CAST(100 * x * 1000 // top AS BIGINT) AS v FROM cell JOIN top USING (k)),
need AS (SELECT k, CAST(sum(m) AS BIGINT) * 90 // 100 AS need FROM (SELECT k, i, max(v) AS m FROM scaled GROUP BY k, i) GROUP BY k),
l AS (SELECT unnest(['a', 'c', 'g', 't']) AS b),
word AS (SELECT a.b || b.b || c.b || d.b || e.b || f.b AS w FROM l a, l b, l c, l d, l e, l f),
score AS (SELECT k, w, CAST(sum(v) AS BIGINT) AS score FROM word, range(6) r(i), scaled s WHERE s.i = r.i AND s.b = substr(w, r.i + 1, 1) GROUP BY k, w),
good AS (SELECT k, w, score FROM score JOIN need USING (k) WHERE score >= need),
top_hits AS (SELECT seq_id, p, substr(seq, p, 6) AS w FROM seqs, unnest(range(1, length(seq) - 4)) AS t(p)),
hit AS (SELECT seq_id, k, 1 AS strand, p, score FROM top_hits JOIN good USING (w) UNION ALL SELECT seq_id, k, -1, p, score FROM top_hits t JOIN good g ON g.w = {REVCOMP.format('t.w')})
SELECT 'x' || k AS pat, CAST(strand AS INTEGER) AS strand, count(*) AS n_hits, CAST(sum(p + 3) AS BIGINT) AS site_sum, CAST(sum(score) AS BIGINT) AS score_sum FROM hit GROUP BY ALL""",
)
def matrix_many(spark, sf_dir):
    """Fifty matrices in one pass."""
    found = match.find_matrices(sequences(spark, sf_dir), _MATRICES, 90)
    return found.groupBy("pat", "strand").agg(F.count(F.lit(1)).alias("n_hits"), F.sum("site").alias("site_sum"), F.sum("score").alias("score_sum"))


MATRIX = [(12, 1, 1, 2), (1, 1, 13, 1), (2, 2, 2, 10), (1, 12, 2, 1), (8, 2, 2, 4), (1, 1, 1, 13)]


def _matrix_sql(strand: int) -> str:
    # By hand: cells times 1000 / 16 without fractions, and 80 percent of the greatest cells' sum of 4249.
    rows, need = [[750, 62, 62, 125], [62, 62, 812, 62], [125, 125, 125, 625], [62, 750, 125, 62], [500, 125, 125, 250], [62, 62, 62, 812]], 3399
    rows = rows if strand == 1 else [r[::-1] for r in rows[::-1]]
    score = " + ".join("CASE substr(seq, p + {}, 1) {} END".format(i, " ".join(f"WHEN '{b}' THEN {r[j]}" for j, b in enumerate("acgt"))) for i, r in enumerate(rows))
    return f"SELECT * FROM (SELECT seq_id, {strand} AS strand, p AS start, p + {len(rows) // 2} AS site, CAST({score} AS BIGINT) AS score FROM seqs, unnest(range(1, length(seq) - {len(rows)} + 2)) AS t(p)) WHERE score >= {need}"


@query("matrix_hits", f"WITH {SEQ} {_matrix_sql(1)} UNION ALL {_matrix_sql(-1)}")
def matrix_hits(spark, sf_dir):
    return match.find_matrix(sequences(spark, sf_dir), "demo", MATRIX, 80).select("seq_id", "strand", "start", "site", "score")


# ------------------------------------------------------------- derived tables


@query("hit_summary", with_hits(DEMO, "SELECT pat, count(DISTINCT seq_id) AS n_seqs, count(*) AS n_hits, CAST(sum(site) AS BIGINT) AS site_sum FROM sites GROUP BY pat"))
def hit_summary(spark, sf_dir):
    return derive.pattern_summary(sites(spark, sf_dir, DEMO))


@query("zero_cutters", with_hits(DEMO, "SELECT * FROM (VALUES " + ", ".join(f"('{p.name}')" for p in DEMO) + ") v(pat) WHERE pat NOT IN (SELECT pat FROM sites)"))
def zero_cutters(spark, sf_dir):
    return derive.zero_cutters(sites(spark, sf_dir, DEMO), DEMO)


@query("idonly_semi", with_hits(FEW, "SELECT seq_id, length(seq) AS seq_len FROM seqs WHERE seq_id IN (SELECT seq_id FROM hits)"))
def idonly_semi(spark, sf_dir):
    return derive.with_hits(sequences(spark, sf_dir), hits(spark, sf_dir, FEW)).select("seq_id", F.length("seq").cast("long").alias("seq_len"))


@query("min_max_hits", with_hits(SOME, "SELECT seq_id, pat, count(*) AS n_hits FROM sites GROUP BY ALL HAVING count(*) BETWEEN 2 AND 5"))
def min_max_hits(spark, sf_dir):
    return derive.between_hits(sites(spark, sf_dir, SOME), 2, 5)


@query("pattern_min_max", with_hits(SOME, "SELECT seq_id, pat, count(*) AS n_hits FROM sites GROUP BY ALL HAVING CASE pat WHEN 'HinfI' THEN count(*) BETWEEN 3 AND 4 WHEN 'TaqI' THEN count(*) = 1 ELSE count(*) <= 6 END"))
def pattern_min_max(spark, sf_dir):
    return derive.between_own_hits(sites(spark, sf_dir, SOME), bounded(SOME, [parse_rule("R,(HinfI:3:4&taqi:1:1),100")]), 1, 6)


@query("strider_order", with_hits(SOME, "SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY n_hits, pat) AS place FROM (SELECT seq_id, pat, count(*) AS n_hits FROM sites GROUP BY ALL)"))
def strider_order(spark, sf_dir):
    return derive.strider_order(sites(spark, sf_dir, SOME))


@query("sites_table", with_hits(FEW, "SELECT seq_id, pat, count(*) AS n_sites, string_agg(site, ' ' ORDER BY site) AS sites FROM sites GROUP BY ALL"))
def sites_table(spark, sf_dir):
    return derive.sites_table(hits(spark, sf_dir, FEW))


@query("signed_sites_table", with_hits([NAMED["BsmAI"]], "SELECT seq_id, pat, count(*) AS n_sites, string_agg(site * strand, ' ' ORDER BY site, strand) AS sites FROM (SELECT DISTINCT seq_id, pat, site, strand FROM hits) GROUP BY ALL"))
def signed_sites_table(spark, sf_dir):
    return derive.sites_table(hits(spark, sf_dir, [NAMED["BsmAI"]]), True)


LINEAR = """f AS (SELECT seq_id, pat, row_number() OVER w AS frag_no, coalesce(lag(site) OVER w, 0) AS begin_site, site AS end_site FROM {0} WINDOW w AS (PARTITION BY seq_id, pat ORDER BY site)
UNION ALL SELECT seq_id, pat, count(*) + 1, max(site), any_value(seq_len) FROM {0} GROUP BY seq_id, pat)"""
FRAGMENT = "SELECT seq_id, pat, frag_no, begin_site, end_site, end_site - begin_site AS frag_len FROM f"


@query("fragments_linear", with_hits(FEW, ", " + LINEAR.format("sites") + " " + FRAGMENT))
def fragments_linear(spark, sf_dir):
    return derive.fragments(sites(spark, sf_dir, FEW))


@query(
    "fragments_circular",
    with_hits(FEW, "SELECT seq_id, pat, row_number() OVER w AS frag_no, coalesce(lag(site) OVER w, max(site) OVER p) AS begin_site, site AS end_site, CASE WHEN lag(site) OVER w IS NULL THEN site + seq_len - max(site) OVER p ELSE site - lag(site) OVER w END AS frag_len FROM sites WINDOW w AS (PARTITION BY seq_id, pat ORDER BY site), p AS (PARTITION BY seq_id, pat)", circular=True),
)
def fragments_circular(spark, sf_dir):
    return derive.fragments(sites(spark, sf_dir, FEW, circular=True), circular=True)


COMBINED = "comb AS (SELECT DISTINCT seq_id, seq_len, 'Combined' AS pat, site FROM sites)"


@query("combined_digest", with_hits(FEW, f", {COMBINED}, " + LINEAR.format("comb") + " " + FRAGMENT))
def combined_digest(spark, sf_dir):
    return derive.fragments(derive.combined(sites(spark, sf_dir, FEW)))


@query("tagged_digest", with_hits(FEW, f", {COMBINED}, " + LINEAR.format("comb") + " " + FRAGMENT + " WHERE (seq_id, begin_site) IN (SELECT (seq_id, site) FROM sites WHERE pat = 'RsaI') OR (seq_id, end_site) IN (SELECT (seq_id, site) FROM sites WHERE pat = 'RsaI')"))
def tagged_digest(spark, sf_dir):
    return derive.tagged_digest(sites(spark, sf_dir, FEW), "RsaI")


@query("sorted_fragments", with_hits(FEW, ", " + LINEAR.format("sites") + " SELECT seq_id, pat, row_number() OVER (PARTITION BY seq_id, pat ORDER BY end_site - begin_site, frag_no) AS place, end_site - begin_site AS frag_len FROM f"))
def sorted_fragments(spark, sf_dir):
    from pyspark.sql.window import Window

    f = derive.fragments(sites(spark, sf_dir, FEW))
    return f.select("seq_id", "pat", F.row_number().over(Window.partitionBy("seq_id", "pat").orderBy("frag_len", "frag_no")).cast("long").alias("place"), "frag_len")


@query("binned_hits", with_hits(SOME, "SELECT seq_id, pat, (site // 500 + 1) * 500 AS bin, count(*) AS n_hits FROM sites GROUP BY ALL"))
def binned_hits(spark, sf_dir):
    return derive.binned(sites(spark, sf_dir, SOME), 500)


@query(
    "binned_pivot",
    with_hits(
        FEW,
        ", b AS (SELECT DISTINCT seq_id, unnest(range(1, seq_len // 500 + 2)) * 500 AS bin FROM sites) SELECT seq_id, bin, " + ", ".join(f"(SELECT count(*) FROM sites s WHERE s.seq_id = b.seq_id AND (s.site // 500 + 1) * 500 = b.bin AND s.pat = '{p.name}') AS {p.name}" for p in FEW) + " FROM b",
    ),
)
def binned_pivot(spark, sf_dir):
    return derive.binned_wide(sites(spark, sf_dir, FEW), 500, [p.name for p in FEW])


SENSITIVE = {"dam": ([NAMED["TaqI"], NAMED["MboI"], pt.pattern("BsmAI2", "GTCTC", 6, 4, dam=1, dcm=1)], pt.DAM, 4), "dcm": ([NAMED["HaeIII"], NAMED["HinfI"], pt.pattern("ccg", "CCG", 1, 0, dcm=0)], pt.DCM, 5)}
for _kind, (_ps, _m, _back) in SENSITIVE.items():

    def _masked(spark, sf_dir, kind=_kind, ps=_ps, m=_m):
        return derive.masked(hits(spark, sf_dir, ps), hits(spark, sf_dir, [m]), ps, kind).select("seq_id", "pat", "strand", "site")

    # On the top strand the site and the pattern's offset, on the bottom site - offset + overhang - the methylase's length.
    _off = {
        "dam": "CASE pat WHEN 'TaqI' THEN site + 3 WHEN 'MboI' THEN site WHEN 'BsmAI2' THEN CASE strand WHEN 1 THEN site + 1 ELSE site - 1 + 4 - 4 END END",
        "dcm": "CASE pat WHEN 'HaeIII' THEN site + 2 WHEN 'ccg' THEN CASE strand WHEN 1 THEN site ELSE site - 5 END END",
    }[_kind]
    query(
        f"{_kind}_masked",
        with_hits([*_ps, _m], f", k AS (SELECT *, {_off} AS blocked FROM hits WHERE pat <> '{_kind}') SELECT seq_id, pat, strand, site FROM k WHERE NOT EXISTS (SELECT 1 FROM hits m WHERE m.pat = '{_kind}' AND m.seq_id = k.seq_id AND m.site = k.blocked)"),
    )(_masked)


PROXIMITY = {0: "MboI,300,TaqI", 1: "MboI,g1500,TaqI", 2: "MboI,200-700,TaqI", 3: "MboI,-l500,TaqI", 4: "MboI,-g1500,TaqI", 5: "MboI,-200-700,TaqI", 6: "MboI,+l500,TaqI", 7: "MboI,+g1500,TaqI", 8: "MboI,+200-500,TaqI"}
_HOLDS = {
    0: "abs(b - a) < 300", 1: "abs(b - a) > 1500", 2: "abs(b - a) BETWEEN 200 AND 700", 3: "b > a AND b < a + 500", 4: "b - a > 1500", 5: "b - a BETWEEN 200 AND 700",
    6: "a > b AND a < b + 500", 7: "a - b > 1500", 8: "a - b BETWEEN 200 AND 500",
}
for _k, _spec in PROXIMITY.items():

    def _near(spark, sf_dir, spec=_spec):
        return proximity.near(sites(spark, sf_dir, [NAMED["MboI"], NAMED["TaqI"]]), spec)

    query(f"prox_{_k}", with_hits([NAMED["MboI"], NAMED["TaqI"]], f"SELECT seq_id, a AS site_a, b AS site_b, b - a AS distance FROM (SELECT seq_id, site AS a FROM sites WHERE pat = 'MboI') JOIN (SELECT seq_id, site AS b FROM sites WHERE pat = 'TaqI') USING (seq_id) WHERE {_HOLDS[_k]}"))(_near)


@query("prox_same", with_hits([NAMED["TaqI"]], "SELECT x.seq_id, x.site AS site_a, y.site AS site_b, y.site - x.site AS distance FROM sites x JOIN sites y ON x.seq_id = y.seq_id AND x.site <> y.site AND abs(x.site - y.site) < 200"))
def prox_same(spark, sf_dir):
    return proximity.near(sites(spark, sf_dir, [NAMED["TaqI"]]), "TaqI,200,taqi")


@query(
    "prox_far_counts",
    f"WITH {_JOINED}, {hits_sql([NAMED['MboI'], NAMED['TaqI']])}, a AS (SELECT seq_id, site AS a FROM sites WHERE pat = 'MboI'), b AS (SELECT seq_id, site AS b FROM sites WHERE pat = 'TaqI') "
    + " UNION ALL ".join(f"SELECT {k} AS search, seq_id, a AS site_a, count(*) AS n FROM a JOIN b USING (seq_id) WHERE {w} GROUP BY ALL" for k, w in ((1, "abs(b - a) > 5000"), (4, "b - a > 5000"), (7, "a - b > 5000"))),
)
def prox_far_counts(spark, sf_dir):
    found = derive.distinct_sites(match.find_sites(joined(spark, sf_dir), [NAMED["MboI"], NAMED["TaqI"]]))
    parts = [proximity.far_counts(found, spec).select(F.lit(k).alias("search"), "seq_id", "site_a", "n") for k, spec in ((1, "MboI,g5000,TaqI"), (4, "MboI,-g5000,TaqI"), (7, "MboI,+g5000,TaqI"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


RANGES = [(100, 400, True), (401, 600, False), (900, 1500, True)]


@query(
    "clone_ranges",
    with_hits(SOME, ", m AS (SELECT seq_id, pat, max(CAST(site BETWEEN 100 AND 400 AS BIGINT)) AS rule_1, 1 - max(CAST(site > 401 AND site < 600 AS BIGINT)) AS rule_2, max(CAST(site BETWEEN 900 AND 1500 AS BIGINT)) AS rule_3 FROM sites GROUP BY ALL) SELECT *, rule_1 + rule_2 + rule_3 AS n_met, rule_1 + rule_2 + rule_3 = 3 AS all_met FROM m"),
)
def clone_ranges(spark, sf_dir):
    return derive.clone_ranges(sites(spark, sf_dir, SOME), RANGES)


@query(
    "clone_ladder",
    with_hits(
        SOME,
        """, m AS (SELECT seq_id, pat, max(CAST(site BETWEEN 100 AND 400 AS BIGINT)) AS r1, max(CAST(site > 401 AND site < 600 AS BIGINT)) AS bad, max(CAST(site BETWEEN 900 AND 1500 AS BIGINT)) AS r3 FROM sites GROUP BY ALL),
shown AS (SELECT seq_id, pat, 0 AS section FROM m WHERE r1 = 1 AND r3 = 1 AND bad = 0 UNION ALL SELECT seq_id, pat, 1 FROM m WHERE r1 = 1 AND bad = 0 UNION ALL SELECT seq_id, pat, 2 FROM m WHERE bad = 0 UNION ALL SELECT seq_id, pat, 3 FROM m WHERE r3 = 1 AND bad = 0),
cells AS (SELECT seq_id, pat, greatest(0, CAST(floor(0.5 + site * 60.0::DOUBLE / seq_len) AS BIGINT) - 1) AS cell, count(*) AS n FROM sites GROUP BY 1, 2, 3)
SELECT seq_id, section, pat, cell, n, CASE WHEN n = 1 THEN '|' WHEN n <= 9 THEN CAST(n AS VARCHAR) ELSE '*' END AS mark FROM cells JOIN shown USING (seq_id, pat)""",
    ),
)
def clone_ladder(spark, sf_dir):
    return derive.clone_ladder(sites(spark, sf_dir, SOME), RANGES, 60)


RULES = {
    "rule_and": "R1,(MboI:1:8&TaqI:1:2),200",
    "rule_or": "R2,(HinfI:2|RsaI:2:9),400",
    "rule_xor": "R3,((HinfI:1:3^RsaI:1)&TaqI:1:20),600",
    "rule_nested": "R4,(TaqI:1|(RsaI:1&(HinfI:0:0^MboI:2))),300",
}
# Name, window, patterns and condition of each, worked out by hand.
FIXED_RULES = {
    "rule_and": ("R1", 200, ["MboI", "TaqI"], "n_MboI BETWEEN 1 AND 8 AND n_TaqI BETWEEN 1 AND 2"),
    "rule_or": ("R2", 400, ["HinfI", "RsaI"], "n_HinfI >= 2 OR n_RsaI BETWEEN 2 AND 9"),
    "rule_xor": ("R3", 600, ["HinfI", "RsaI", "TaqI"], "(n_HinfI BETWEEN 1 AND 3) <> (n_RsaI >= 1) AND n_TaqI BETWEEN 1 AND 20"),
    "rule_nested": ("R4", 300, ["TaqI", "RsaI", "HinfI", "MboI"], "n_TaqI >= 1 OR (n_RsaI >= 1 AND (n_HinfI = 0) <> (n_MboI >= 2))"),
}
for _name, _text in RULES.items():
    _rule = parse_rule(_text)

    def _windows(spark, sf_dir, rule=_rule):
        return windows.rule_windows(sites(spark, sf_dir, pt.select(DEMO, [t.name for t in rule.terms])), rule)

    _said, _width, _names, _holds = FIXED_RULES[_name]
    _counts = ", ".join(f"CAST(sum(CAST(pat = '{n}' AS INT)) OVER w AS BIGINT) AS n_{n}" for n in _names)
    query(
        _name,
        with_hits(
            _names,
            f", w AS (SELECT DISTINCT seq_id, site AS lo, max(site) OVER w AS hi, {_counts} FROM sites WINDOW w AS (PARTITION BY seq_id ORDER BY site RANGE BETWEEN CURRENT ROW AND {_width} FOLLOWING)) SELECT '{_said}' AS rule_name, seq_id, lo, hi, hi - lo AS width, {', '.join(f'n_{n}' for n in _names)} FROM w WHERE {_holds}",
        ),
    )(_windows)


@query("extract_context", with_hits(FEW + [NAMED["BsmAI"]], f"SELECT h.seq_id, pat, strand, site, greatest(1, site - 10) AS lo, least(length(seq), site + 12) AS hi, CASE WHEN strand = -1 THEN {REVCOMP.format('x')} ELSE x END AS bases FROM (SELECT h.*, seq, substr(seq, greatest(1, site - 10), least(length(seq), site + 12) - greatest(1, site - 10) + 1) AS x FROM hits h JOIN seqs USING (seq_id)) h"))
def extract_context(spark, sf_dir):
    return derive.extract(sequences(spark, sf_dir), hits(spark, sf_dir, FEW + [NAMED["BsmAI"]]), 10, 12, True)


@query("ladder_cells", with_hits(SOME, "SELECT seq_id, pat, greatest(0, CAST(floor(0.5 + site * 60.0::DOUBLE / seq_len) AS BIGINT) - 1) AS cell, count(*) AS n, CASE WHEN count(*) = 1 THEN '|' WHEN count(*) <= 9 THEN CAST(count(*) AS VARCHAR) ELSE '*' END AS mark FROM sites GROUP BY 1, 2, 3"))
def ladder_cells(spark, sf_dir):
    return derive.ladder_cells(sites(spark, sf_dir, SOME), 60)


@query("few_cutters", with_hits(SOME, "SELECT seq_id, pat, count(*) AS n_hits, min(site) AS first_site FROM sites GROUP BY seq_id, seq_len, pat HAVING count(*) <= CASE WHEN seq_len > 10000 THEN floor(log10(seq_len)) - 2 ELSE 1 END"))
def few_cutters(spark, sf_dir):
    return derive.few_cutters(sites(spark, sf_dir, SOME))


@query("gel_cells", with_hits(FEW, ", " + LINEAR.format("sites") + ", g AS (SELECT seq_id, pat, end_site - begin_site AS n FROM f) SELECT seq_id, pat, CASE WHEN n < 100 THEN 0 ELSE least(70, CAST(floor(0.5 + 70.0::DOUBLE * (log10(n) - log10(100.0::DOUBLE)) / (log10(5000.0::DOUBLE) - log10(100.0::DOUBLE))) AS BIGINT)) END AS cell, count(*) AS n FROM g GROUP BY 1, 2, 3"))
def gel_cells(spark, sf_dir):
    return derive.gel_cells(derive.fragments(sites(spark, sf_dir, FEW)), 70, 100, 5000)


@query("plasmid_angles", with_hits(FEW, "SELECT seq_id, pat, site, CAST(floor(site * 360000 / CAST(seq_len AS DOUBLE)) AS BIGINT) AS angle FROM sites"))
def plasmid_angles(spark, sf_dir):
    return derive.plasmid_angles(sites(spark, sf_dir, FEW))


@query(
    "linear_map_rows",
    with_hits(FEW, f", b AS (SELECT seq_id, k AS block_no, k * 60 + 1 AS begin, substr(seq, k * 60 + 1, 60) AS bases FROM seqs, unnest(range(0, (length(seq) + 59) // 60)) AS t(k)), l AS (SELECT seq_id, (site - 1) // 60 AS block_no, string_agg(pat || ':' || site, ' ' ORDER BY site, pat) AS labels FROM sites GROUP BY 1, 2) SELECT seq_id, block_no, begin, bases, {COMPLEMENT.format('bases')} AS other, coalesce(labels, '') AS labels FROM b LEFT JOIN l USING (seq_id, block_no)"),
)
def linear_map_rows(spark, sf_dir):
    return derive.linear_map(sequences(spark, sf_dir), sites(spark, sf_dir, FEW), 60)


# ------------------------------------------------------- translation, frames


# The published codes by number, codons in the order ttt ttc tta ttg tct ... ggg.
CODES = [
    "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
    "FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    "FFLLSSSSYY**CCCWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSGGVVVVAAAADDEEGGGG",
    "FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    "FFLLSSSSYY*QCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
]


def _protein_sql(frame: int, table: int = 0, seq: str = "seq") -> str:
    s = f"substr({seq}, {(frame - 1) % 3 + 1})" if frame <= 3 else f"substr({REVCOMP.format(seq)}, {(frame - 1) % 3 + 1})"
    place = " + ".join(f"{w} * (strpos('tcag', c[{k}]) - 1)" for k, w in ((1, 16), (2, 4), (3, 1)))
    return f"coalesce(array_to_string(list_transform(regexp_extract_all({s}, '(...)', 1), lambda c: substr('{CODES[table]}', {place} + 1, 1)), ''), '')"


for _f in orfs.FRAMES:

    def _frame(spark, sf_dir, frame=_f):
        return orfs.frames(sequences(spark, sf_dir), [frame]).select("seq_id", "frame", "protein")

    query(f"translate_frame{_f}", f"WITH {SEQ} SELECT seq_id, {_f} AS frame, {_protein_sql(_f)} AS protein FROM seqs")(_frame)


@query("translate_mito", f"WITH {SEQ} SELECT seq_id, {_protein_sql(1, 1)} AS protein FROM seqs")
def translate_mito(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", cod.translate("seq", 1, 1).alias("protein"))


@query("translate_all_tables", f"WITH {SEQ} " + " UNION ALL ".join(f"SELECT seq_id, {k} AS code, {_protein_sql(1, k)} AS protein FROM seqs" for k in range(len(CODES))))
def translate_all_tables(spark, sf_dir):
    return orfs.translations(sequences(spark, sf_dir), tuple(cod.DIFFERENCES))


@query("translate_three", f"WITH {SEQ} SELECT seq_id, coalesce(array_to_string(list_transform(regexp_extract_all({_protein_sql(1)}, '(.)', 1), lambda a: MAP {{{', '.join(f"'{k}': '{v}'" for k, v in cod.THREE.items())}}}[a]), ''), '') AS protein FROM seqs")
def translate_three(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", cod.translate("seq", 1, 0, 3).alias("protein"))


_BACK = "MAP {'A': 'gcn', 'R': 'mgn', 'N': 'aay', 'D': 'gay', 'C': 'tgy', 'Q': 'car', 'E': 'gar', 'G': 'ggn', 'H': 'cay', 'I': 'ath', 'L': 'ytn', 'K': 'aar', 'M': 'atg', 'F': 'tty', 'P': 'ccn', 'S': 'wsn', 'T': 'acn', 'W': 'tgg', 'Y': 'tay', 'V': 'gtn', '*': 'trr'}"
_SILENT = f"coalesce(array_to_string(list_transform(regexp_extract_all({_protein_sql(1)}, '(.)', 1), lambda a: {_BACK}[a]), ''), '')"


@query("reverse_translate", f"WITH {SEQ} SELECT seq_id, {_SILENT} AS seq FROM seqs")
def reverse_translate(spark, sf_dir):
    return orfs.silent(sequences(spark, sf_dir))


_BACK_SEQ = f"base AS (SELECT * FROM ({SEQ.removeprefix('seqs AS (').removesuffix(')')})), seqs AS (SELECT seq_id, {_SILENT} AS seq FROM base)"

for _mode, _name in (("subset", "silent_sites"), ("overlap", "silent_sites_any")):

    def _silent_sites(spark, sf_dir, mode=_mode):
        return match.find_sites(orfs.silent(sequences(spark, sf_dir)), [NAMED["HinfI"], NAMED["BsmAI"]], mode=mode).select("seq_id", "pat", "strand", "start")

    query(_name, with_hits(["HinfI", "BsmAI"], "SELECT seq_id, pat, strand, start FROM hits", _mode, _BACK_SEQ))(_silent_sites)


@query("codon_usage", f"WITH {SEQ} SELECT codon, count(*) AS n FROM (SELECT unnest(regexp_extract_all(seq, '(...)', 1)) AS codon FROM seqs) GROUP BY 1")
def codon_usage(spark, sf_dir):
    return orfs.codon_usage(sequences(spark, sf_dir))


_ORFS = f"""{SEQ}, pr AS ({" UNION ALL ".join(f"SELECT seq_id, {f} AS frame, {_protein_sql(f)} AS protein FROM seqs" for f in orfs.FRAMES)}),
pieces AS (SELECT seq_id, frame, unnest(string_split(protein, '*')) AS piece, generate_subscripts(string_split(protein, '*'), 1) AS k FROM pr),
placed AS (SELECT *, sum(length(piece) + 1) OVER (PARTITION BY seq_id, frame ORDER BY k) - length(piece) - 1 AS before FROM pieces),
begun AS (SELECT *, CASE WHEN k = 1 THEN 0 ELSE strpos(piece, 'M') - 1 END AS skip FROM placed),
o AS (SELECT seq_id, frame, CAST(before + skip + 1 AS BIGINT) AS aa_begin, substr(piece, skip + 1) AS peptide FROM begun WHERE skip >= 0 AND length(piece) - skip >= 20),
orfs AS (SELECT seq_id, frame, aa_begin, aa_begin + length(peptide) - 1 AS aa_end, length(peptide) AS aa_len, (frame - 1) % 3 + (aa_begin - 1) * 3 + 1 AS bp_begin, (frame - 1) % 3 + (aa_begin + length(peptide) - 1) * 3 AS bp_end, peptide, row_number() OVER (PARTITION BY seq_id, frame ORDER BY aa_begin) AS orf_no FROM o)"""


@query("orf_table", f"WITH {_ORFS} SELECT * FROM orfs")
def orf_table(spark, sf_dir):
    return orfs.orfs(sequences(spark, sf_dir), 20)


@query("orf_long", f"WITH {_ORFS.replace(SEQ, _JOINED)} SELECT * FROM orfs")
def orf_long(spark, sf_dir):
    """Reading frames of sequences that no row holds whole, over the edges of many chunks."""
    return orfs.orfs(joined(spark, sf_dir), 20, chunk=3 << 10)


@query("orf_composition", f"WITH {_ORFS} SELECT seq_id, frame, orf_no, aa, count(*) AS n, round(100.0::DOUBLE * count(*) / aa_len, 4) AS percent FROM (SELECT seq_id, frame, orf_no, aa_len, unnest(string_split(peptide, '')) AS aa FROM orfs) GROUP BY seq_id, frame, orf_no, aa_len, aa")
def orf_composition(spark, sf_dir):
    return orfs.composition(orfs.orfs(sequences(spark, sf_dir), 20))


_MASS = " + ".join([str(cod.WATER_MASS), *(f"(length(peptide) - length(replace(peptide, '{aa}', ''))) * {m}" for aa, m in cod.RESIDUE_MASS.items())])


@query("orf_weights", f"WITH {_ORFS} SELECT seq_id, frame, orf_no, round(({_MASS})::DOUBLE / 1000, 4) AS mol_wt_kd FROM orfs")
def orf_weights(spark, sf_dir):
    return orfs.orfs(sequences(spark, sf_dir), 20).select("seq_id", "frame", "orf_no", F.round(cod.molecular_weight("peptide"), 4).alias("mol_wt_kd"))


_ENDS = {"K": 10.5, "R": 12.5, "H": 6.0}, {"D": 3.65, "E": 4.25, "C": 8.18, "Y": 10.07}
_CHARGE = (
    "0.0 "
    + " ".join(f"+ n_{aa} / (1 + pow(10.0::DOUBLE, mid - {pk}))" for aa, pk in _ENDS[0].items())
    + " + 1.0 / (1 + pow(10.0::DOUBLE, mid - 9.69)) "
    + " ".join(f"- n_{aa} / (1 + pow(10.0::DOUBLE, {pk} - mid))" for aa, pk in _ENDS[1].items())
    + " - 1.0 / (1 + pow(10.0::DOUBLE, 2.34 - mid))"
)


@query(
    "orf_isoelectric",
    f"""WITH RECURSIVE {_ORFS}, c AS (SELECT seq_id, frame, orf_no, {', '.join(f"CAST(length(peptide) - length(replace(peptide, '{aa}', '')) AS DOUBLE) AS n_{aa}" for aa in 'KRHDECY')} FROM orfs),
half AS (SELECT *, 0.0::DOUBLE AS lo, 14.0::DOUBLE AS hi, 0 AS k FROM c UNION ALL
SELECT seq_id, frame, orf_no, n_K, n_R, n_H, n_D, n_E, n_C, n_Y, CASE WHEN {_CHARGE} > 0 THEN mid ELSE lo END, CASE WHEN {_CHARGE} > 0 THEN hi ELSE mid END, k + 1 FROM (SELECT *, (lo + hi) / 2 AS mid FROM half WHERE k < 24))
SELECT seq_id, frame, orf_no, round((lo + hi) / 2, 3) AS pi FROM half WHERE k = 24""",
)
def orf_isoelectric(spark, sf_dir):
    return orfs.orfs(sequences(spark, sf_dir), 20).select("seq_id", "frame", "orf_no", F.round(cod.isoelectric_point("peptide"), 3).alias("pi"))


@query("orf_fasta", f"WITH {_ORFS} SELECT seq_id, frame, orf_no, '>' || seq_id || ' frame ' || frame || ' orf ' || orf_no || ' bases ' || bp_begin || '-' || bp_end || chr(10) || peptide AS record FROM orfs")
def orf_fasta(spark, sf_dir):
    return orfs.fasta(orfs.orfs(sequences(spark, sf_dir), 20))


@query("metstop", f"WITH {SEQ}, p AS (SELECT seq_id, 1 AS frame, {_protein_sql(1)} AS protein FROM seqs), c AS (SELECT seq_id, frame, k, substr(protein, k, 1) AS aa FROM p, unnest(range(1, length(protein) + 1)) AS t(k)) SELECT seq_id, frame, CASE aa WHEN 'M' THEN k ELSE -k END AS place FROM c WHERE aa IN ('M', '*')")
def metstop(spark, sf_dir):
    return orfs.starts_and_stops(sequences(spark, sf_dir), [1])


_TOP = "CASE WHEN frame > 3 THEN seq_len - {} + 1 ELSE {} END"


@query("orf_map_cells", f"WITH {_ORFS}, m AS (SELECT o.*, length(seq) AS seq_len FROM orfs o JOIN seqs USING (seq_id)) SELECT seq_id, frame, orf_no, ({_TOP.format('bp_end', 'bp_begin')} - 1) * 80 // seq_len AS first_cell, ({_TOP.format('bp_begin', 'bp_end')} - 1) * 80 // seq_len AS last_cell FROM m")
def orf_map_cells(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return orfs.orf_map(orfs.orfs(s, 20), s, 80)


@query(
    "cotranslation",
    f"WITH {SEQ}, b AS (SELECT seq_id, k AS block_no, seq FROM seqs, unnest(range(0, (length(seq) + 59) // 60)) AS t(k)), x AS ("
    + " UNION ALL ".join(f"SELECT seq_id, block_no, {f} AS frame, substr(seq, block_no * 60 + {f}, 60) AS part FROM b" for f in (1, 2, 3))
    + f") SELECT seq_id, block_no, frame, {_protein_sql(1, 0, 'part')} AS protein FROM x",
)
def cotranslation(spark, sf_dir):
    return orfs.cotranslation(sequences(spark, sf_dir))


# --------------------------------------------------------------------- readers

#: A record of each format as text, in SQL of seq_id and seq.
_SIXTY = "regexp_replace(seq, '(.{60})', '$1\n')"
_RECORDS = {
    "fasta": f"concat('>d', seq_id, ' a title\n', {_SIXTY})",
    "genbank": f"concat('LOCUS       d', seq_id, ' x\nDEFINITION  a title\nORIGIN\n        1 ', {_SIXTY}, '\n//')",
    "embl": f"concat('ID   d', seq_id, ' x\nDE   a title\nSQ   Sequence\n     ', {_SIXTY}, '\n//')",
    "nbrf": f"concat('>DL;d', seq_id, '\na title\n', {_SIXTY}, '*')",
    "pir": f"concat('ENTRY           d', seq_id, '\nTITLE           a title\nSEQUENCE\n                5        10\n      1 ', {_SIXTY}, '\n///')",
    "ig": f"concat('; a title\nd', seq_id, '\n', {_SIXTY}, '1')",
}
_READ_SQL = f"WITH {IUPAC_SEQ} SELECT 'd' || seq_id AS name, '{{}}' AS format, seq, length(seq) AS seq_len FROM seqs WHERE seq <> ''"
_SPLIT_SQL = "WITH {}, cuts AS (SELECT name, seq, unnest(range(0, length(seq), 1000)) AS base FROM named) SELECT name, base, substring(seq, base + 1, 1000) AS bases FROM cuts"


def _thousands(spark, path: str, kind: str) -> DataFrame:
    """Records read by byte ranges, cut anew at every thousand letters."""
    headers, parts = split.read_both(spark, path, kind)
    return cut(parts, 0, 1000).join(headers, "seq_id").select("name", "base", F.col("piece").alias("bases"))


for _kind, _record in _RECORDS.items():

    def _read(spark, sf_dir, kind=_kind, record=_record):
        path = files.scratch(spark, f"{kind}-files")
        sequences(spark, sf_dir, True).where("seq <> ''").select(F.expr(record).alias("value")).write.text(path)
        return read_sequences(spark, path, kind).select("name", "format", "seq", "seq_len")

    def _split(spark, sf_dir, kind=_kind, record=_record):
        path = files.scratch(spark, f"{kind}-ranges")
        sequences(spark, sf_dir, True).where("seq <> ''").select(F.expr(record).alias("value")).write.text(path)
        return _thousands(spark, path, kind)

    query(f"read_{_kind}", _READ_SQL.format(_kind))(_read)
    query(f"split_{_kind}", _SPLIT_SQL.format(f"{IUPAC_SEQ}, named AS (SELECT 'd' || seq_id AS name, seq FROM seqs WHERE seq <> '')"))(_split)


#: Files of many sequences, each in two parts: their text in SQL of the lines "named", "one" and "two".
_ALIGNED = {
    "msf": "concat(' x  MSF: 9  Type: N  Check: 1 ..\n\n', named, '\n\n//\n\n', one, '\n\n', two, '\n')",
    "paup": "concat('#NEXUS\nbegin data;\n matrix\n\n', one, '\n\n', two, '\n;\nend;\n')",
}
for _kind, _text in _ALIGNED.items():

    def _write_many(spark, sf_dir, path, text):
        """A file per group of a hundred documents."""
        s = sequences(spark, sf_dir, True).where("seq <> ''").select(F.floor(F.col("seq_id") / 100).alias("file"), F.expr("concat('d', seq_id)").alias("name"), "seq", F.expr("cast(ceil(length(seq) / 2) as int)").alias("half"))
        lines = s.select("file", F.expr("concat(' Name: ', name, '   Len: 9')").alias("named"), F.expr("concat(name, ' ', substring(seq, 1, half))").alias("one"), F.expr("concat(name, ' ', substring(seq, half + 1))").alias("two"))
        each = lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("named", "one", "two"))).alias("p"))
        blocks = each.select("file", *[F.array_join(F.col(f"p.{c}"), "\n").alias(c) for c in ("named", "one", "two")])
        blocks.select("file", F.expr(text).alias("value")).write.partitionBy("file").text(path)

    def _read_many(spark, sf_dir, kind=_kind, text=_text):
        path = files.scratch(spark, f"{kind}-files")
        _write_many(spark, sf_dir, path, text)
        return read_sequences(spark, path, kind).select("name", "format", "seq", "seq_len")

    def _split_many(spark, sf_dir, kind=_kind, text=_text):
        path = files.scratch(spark, f"{kind}-ranges")
        _write_many(spark, sf_dir, path, text)
        return _thousands(spark, path, kind)

    query(f"read_{_kind}", _READ_SQL.format(_kind))(_read_many)
    query(f"split_{_kind}", _SPLIT_SQL.format(f"{IUPAC_SEQ}, named AS (SELECT 'd' || seq_id AS name, seq FROM seqs WHERE seq <> '')"))(_split_many)


#: Formats of one record: files of a hundred documents each, as text in SQL of name and seq.
_SINGLE = {
    "gcg": f"concat('a title\n\n', name, '  Length: 9  Check: 1  ..\n\n       1  ', {_SIXTY}, '\n')",
    "strider": f"concat('; ### from DNA Strider ###\n; DNA sequence ', name, ', 9 bp\n;\n', {_SIXTY}, '\n//\n')",
    "fitch": f"concat(name, ', 9 bases\n ', regexp_replace(seq, '(.{{3}})', '$1 '), '\n')",
}
_HUNDRED = f"{IUPAC_SEQ.replace('seqs AS', 'single AS')}, seqs AS (SELECT 'd' || seq_id // 100 AS name, string_agg(seq, '' ORDER BY seq_id) AS seq FROM single GROUP BY 1)"


def _hundreds(spark, sf_dir) -> DataFrame:
    rows = sequences(spark, sf_dir, True).groupBy(F.floor(F.col("seq_id") / 100).alias("file")).agg(F.array_sort(F.collect_list(F.struct("seq_id", "seq"))).alias("x"))
    return rows.select("file", F.concat(F.lit("d"), F.col("file").cast("string")).alias("name"), F.array_join("x.seq", "").alias("seq"))


for _kind, _text in _SINGLE.items():

    def _read_single(spark, sf_dir, kind=_kind, text=_text):
        path = files.scratch(spark, f"{kind}-files")
        _hundreds(spark, sf_dir).select("file", F.expr(text).alias("value")).write.partitionBy("file").text(path)
        return read_sequences(spark, path, kind).select("name", "format", "seq", "seq_len")

    def _split_single(spark, sf_dir, kind=_kind, text=_text):
        path = files.scratch(spark, f"{kind}-ranges")
        _hundreds(spark, sf_dir).select("file", F.expr(text).alias("value")).write.partitionBy("file").text(path)
        return _thousands(spark, path, kind)

    query(f"split_{_kind}", _SPLIT_SQL.format(f"{_HUNDRED}, named AS (SELECT name, seq FROM seqs WHERE seq <> '')"))(_split_single)
    query(f"read_{_kind}", f"WITH {_HUNDRED} SELECT name, '{_kind}' AS format, seq, length(seq) AS seq_len FROM seqs")(_read_single)

_MIXED = {**_SINGLE, "genbank": _RECORDS["genbank"].replace("seq_id, ' x", "substring(name, 2), ' 9 bp DNA circular"), "fasta": _RECORDS["fasta"].replace("seq_id", "substring(name, 2)")}


@query(
    "read_auto",
    f"WITH {_HUNDRED}, k AS (SELECT *, [{', '.join(repr(x) for x in _MIXED)}][CAST(substr(name, 2) AS BIGINT) % {len(_MIXED)} + 1] AS format FROM seqs) SELECT name, format, seq, length(seq) AS seq_len, CAST(CASE format WHEN 'genbank' THEN 0 ELSE 1 END AS TINYINT) AS topology FROM k",
)
def read_auto(spark, sf_dir):
    """Files of five formats in one folder, each told by its text; a record's own topology."""
    path = files.scratch(spark, "mixed-files")
    k = F.pmod(F.col("file"), F.lit(len(_MIXED)))
    text = F.coalesce(*(F.when(k == i, F.expr(x)) for i, x in enumerate(_MIXED.values())))
    _hundreds(spark, sf_dir).select("file", text.alias("value")).write.partitionBy("file").text(path)
    return read_sequences(spark, path).select("name", "format", "seq", "seq_len", "topology")


# ------------------------------------------------------- files of patterns, expressions, matrices, rules, codons


def _text_file(spark: SparkSession, name: str, text: str) -> str:
    path = files.scratch(spark, name)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


@query("pattern_file_hits", with_hits(SOME, "SELECT seq_id, pat, strand, start, site FROM hits"))
def pattern_file_hits(spark, sf_dir):
    """Patterns logged to a file and read back."""
    path = files.scratch(spark, "patterns")
    files.log_patterns(spark, SOME, path)
    return hits(spark, sf_dir, [p for text in spark.read.text(path).collect() for p in files.parse_patterns(text["value"])]).select("seq_id", "pat", "strand", "start", "site")


@query("command_line_hits", with_hits(["rgcy", "gantc"], "SELECT seq_id, pat, strand, start FROM hits"))
def command_line_hits(spark, sf_dir):
    return hits(spark, sf_dir, [pt.command_line_pattern("rgcy,RGCY"), pt.command_line_pattern("gantc,nGANTCn,0")]).select("seq_id", "pat", "strand", "start")


@query("regex_file_sites", f"WITH {SEQ} {_regex_sql(1, _FIXED_EXPRESSIONS)} UNION ALL {_regex_sql(-1, _FIXED_EXPRESSIONS)}")
def regex_file_sites(spark, sf_dir):
    path = _text_file(spark, "expressions", "; two expressions\n..\nrx1 ga(tt|ac)n{1,3}y ! first\nrx2   wt{2,4}ar\n")
    return match.find_regex(sequences(spark, sf_dir), files.regex_option(spark, f"FILE:{path}")).select("seq_id", "pat", "strand", "site")


@query("matrix_file_hits", f"WITH {SEQ} {_matrix_sql(1)} UNION ALL {_matrix_sql(-1)}")
def matrix_file_hits(spark, sf_dir):
    rows = "\n".join(f"{i:02d} " + " ".join(map(str, r)) + " n" for i, r in enumerate(MATRIX, 1))
    found = files.read_matrices(spark, _text_file(spark, "matrices", f"AC  M1\nNA  demo\nDE  a matrix\nP0  A C G T\n{rows}\n//\n"))
    return match.find_matrices(sequences(spark, sf_dir), [(m["name"], m["counts"]) for m in found], 80).select("seq_id", "strand", "start", "site", "score")


@query("consensus_sites", f"WITH {SEQ} SELECT seq_id, 1 AS strand, p AS start FROM seqs, unnest(range(1, length(seq) - 4)) AS t(p) WHERE regexp_full_match(substr(seq, p, 6), 'ag[at]c[at]t') UNION ALL SELECT seq_id, -1, p FROM seqs, unnest(range(1, length(seq) - 4)) AS t(p) WHERE p + 6 <= length(seq) AND regexp_full_match(substr(seq, p, 6), 'a[at]g[at]ct')")
def consensus_sites(spark, sf_dir):
    """A matrix's consensus as a pattern."""
    return hits(spark, sf_dir, [pt.Pattern("consensus", match.consensus(MATRIX, 75))]).select("seq_id", "strand", "start")


def _rule_file_sql(rules: list[str]) -> str:
    parts = []
    for name, width, names, holds in (FIXED_RULES[r] for r in rules):
        counts = ", ".join(f"CAST(sum(CAST(pat = '{n}' AS INT)) OVER w AS BIGINT) AS n_{n}" for n in names)
        inside = f"SELECT DISTINCT seq_id, site AS lo, max(site) OVER w AS hi, {counts} FROM sites WHERE pat IN ({', '.join(repr(n) for n in names)}) WINDOW w AS (PARTITION BY seq_id ORDER BY site RANGE BETWEEN CURRENT ROW AND {width} FOLLOWING)"
        parts.append(f"SELECT '{name}' AS rule_name, seq_id, lo, hi, hi - lo AS width FROM ({inside}) WHERE {holds}")
    return " UNION ALL ".join(parts)


@query("rules_file_windows", with_hits(["MboI", "TaqI", "HinfI", "RsaI"], _rule_file_sql(["rule_and", "rule_or", "rule_nested"])))
def rules_file_windows(spark, sf_dir):
    """Every rule of a file."""
    text = "; rules\n..\n" + RULES["rule_and"] + "\n" + RULES["rule_or"].replace("|", "|\\\n") + "\n" + RULES["rule_nested"] + "\n"
    rules = files.read_rules(spark, _text_file(spark, "rules", text))
    own = sorted({t.name for r in rules for t in r.terms})
    return windows.rule_tables(sites(spark, sf_dir, pt.select(DEMO, own)), rules).select("rule_name", "seq_id", "lo", "hi", "width")


@query("codon_file_residues", f"WITH {SEQ}, c AS (SELECT unnest(regexp_extract_all(seq, '(...)', 1)) AS codon FROM seqs) SELECT substr('{CODES[1]}', 16 * (strpos('tcag', substr(codon, 1, 1)) - 1) + 4 * (strpos('tcag', substr(codon, 2, 1)) - 1) + strpos('tcag', substr(codon, 3, 1)), 1) AS aa, count(*) AS n FROM c GROUP BY 1")
def codon_file_residues(spark, sf_dir):
    """Residues by a codon table read from a file."""
    table = cod.codon_table(1)
    cells = "\n".join(f"{c.upper()} {aa}{cod.THREE.get(aa, 'Ter')}" for c, aa in table.items())
    ((_, read),) = files.read_codons(spark, _text_file(spark, "codons", f"# codons\nLabel one\n{cells}\n"))
    residue = spark.createDataFrame(list(read.items()), "codon string, aa string")
    return orfs.codon_usage(sequences(spark, sf_dir)).join(F.broadcast(residue), "codon").groupBy("aa").agg(F.sum("n").alias("n"))


_CELL = "greatest(0, CAST(floor(0.5 + site * 60.0::DOUBLE / seq_len) AS BIGINT) - 1) AS cell, count(*) AS n, CASE WHEN count(*) = 1 THEN '|' WHEN count(*) <= 9 THEN CAST(count(*) AS VARCHAR) ELSE '*' END AS mark"


@query(
    "proximity_ladder",
    with_hits(
        [NAMED["MboI"], NAMED["TaqI"]],
        f""", p AS (SELECT a.seq_id, a.seq_len, a.site AS a, b.site AS b FROM sites a JOIN sites b ON a.seq_id = b.seq_id AND a.pat = 'MboI' AND b.pat = 'TaqI' AND abs(b.site - a.site) < 300),
lanes AS (SELECT seq_id, seq_len, CASE pat WHEN 'MboI' THEN '1 MboI' ELSE '4 TaqI' END AS pat, site FROM sites UNION ALL SELECT DISTINCT seq_id, seq_len, '2 MboI near', a FROM p UNION ALL SELECT DISTINCT seq_id, seq_len, '3 TaqI near', b FROM p)
SELECT seq_id, pat, {_CELL} FROM lanes GROUP BY 1, 2, 3""",
    ),
)
def proximity_ladder(spark, sf_dir):
    own = sites(spark, sf_dir, [NAMED["MboI"], NAMED["TaqI"]])
    return render.proximity_ladder(own, proximity.near(own, "MboI,300,TaqI"), "MboI", "TaqI", 60)


@query(
    "linear_map_layout",
    f"WITH RECURSIVE {SEQ}, {hits_sql(SOME)}, "
    + """lab AS (SELECT seq_id, (site - 1) // 60 AS block_no, site, pat, least((site - 1) % 60, 60 - length(pat)) AS col FROM sites),
o AS (SELECT *, row_number() OVER (PARTITION BY seq_id, block_no ORDER BY col, site, pat) AS i FROM lab),
walk(seq_id, block_no, i, held, r) AS (
  SELECT DISTINCT seq_id, block_no, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS BIGINT) FROM o
  UNION ALL
  SELECT seq_id, block_no, i, CASE WHEN p = 0 THEN list_append(held, fin) ELSE list_transform(range(1, len(held) + 1), lambda k: CASE WHEN k = p THEN fin ELSE held[k] END) END, CASE WHEN p = 0 THEN len(held) + 1 ELSE p END
  FROM (SELECT w.seq_id, w.block_no, o.i, w.held, CAST(o.col + length(o.pat) AS BIGINT) AS fin, CAST(coalesce(list_position(list_transform(w.held, lambda e: e < o.col), true), 0) AS BIGINT) AS p FROM walk w JOIN o ON o.seq_id = w.seq_id AND o.block_no = w.block_no AND o.i = w.i + 1)
)
SELECT o.seq_id, o.block_no, w.r AS label_row, o.col, o.pat, o.site FROM o JOIN walk w ON w.seq_id = o.seq_id AND w.block_no = o.block_no AND w.i = o.i""",
)
def linear_map_layout(spark, sf_dir):
    return derive.label_layout(sites(spark, sf_dir, SOME), 60)
