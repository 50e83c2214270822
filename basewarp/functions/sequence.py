"""Scalar functions of nucleic-acid sequences, all as Column expressions.

Sequences are lower-case IUPAC strings.  Nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC letters and the bases each stands for.
IUPAC = {
    "a": "a", "c": "c", "g": "g", "t": "t",
    "r": "ag", "y": "ct", "w": "at", "s": "cg", "k": "gt", "m": "ac",
    "b": "cgt", "d": "agt", "h": "act", "v": "acg", "n": "acgt",
}
LETTERS = "".join(IUPAC)
BIT = {"a": 1, "c": 2, "g": 4, "t": 8}
MASK = {x: sum(BIT[b] for b in bases) for x, bases in IUPAC.items()}
BY_MASK = {m: x for x, m in MASK.items()}
COMPLEMENT_FROM = "acgtrymkbdhvwsn"
COMPLEMENT_TO = "tgcayrkmvhdbwsn"

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise(text: Text, degenerate: bool = False) -> Column:
    """Any text as a sequence: u as t, upper case as lower, everything but the letters dropped (first, as most of a text goes)."""
    letters = LETTERS if degenerate else "acgt"
    kept = F.regexp_replace(_c(text), f"[^{letters}u{letters.upper()}U]+", "")
    return F.replace(F.lower(kept), F.lit("u"), F.lit("t"))


def subsequence(text: Text, begin: int, end: int = 0) -> Column:
    """Characters begin to end (from 1, inclusive; end 0: to the last), before letters are filtered."""
    return F.substring(_c(text), begin, end - begin + 1 if end else 2**31 - 1 - begin)


def complement(seq: Text) -> Column:
    return F.translate(_c(seq), COMPLEMENT_FROM, COMPLEMENT_TO)


def reverse(seq: Text) -> Column:
    return F.reverse(_c(seq))


def reverse_complement(seq: Text) -> Column:
    return F.reverse(complement(seq))


def triplet_reverse(seq: Text) -> Column:
    """Groups of three in reverse order; a shorter last group is dropped."""
    return F.array_join(F.reverse(F.regexp_extract_all(_c(seq), F.lit("(...)"), F.lit(1))), "")


def is_palindrome(seq: Text) -> Column:
    return _c(seq) == reverse_complement(seq)


def count_of(seq: Text, letters: str) -> Column:
    """How many characters of seq are among letters (distinct ones)."""
    s = _c(seq)
    one = [F.length(s) - F.length(F.replace(s, F.lit(x), F.lit(""))) for x in letters]
    return sum(one[1:], one[0]).cast("long")


def magnitude(seq: Text) -> Column:
    """acgt count 1, two-fold letters 1/2, three-fold 1/4, n 0."""
    return (count_of(seq, "acgt") + count_of(seq, "rywskm") / F.lit(2.0) + count_of(seq, "bdhv") / F.lit(4.0)).cast("double")


def degeneracy(seq: Text) -> Column:
    """Number of plain sequences that seq stands for."""
    two, three, four = (count_of(seq, x) for x in ("rywskm", "bdhv", "n"))
    return (F.pow(F.lit(2.0), two) * F.pow(F.lit(3.0), three) * F.pow(F.lit(4.0), four)).cast("long")


def is_clean(seq: Text) -> Column:
    return ~F.regexp_like(_c(seq), F.lit("[^acgt]"))


def nmer_key(seq: Text) -> Column:
    """Little-endian base-4 number of a clean n-mer (a 0, c 1, g 2, t 3); 0 if it is degenerate."""
    return F.when(is_clean(seq), F.conv(F.translate(F.reverse(_c(seq)), "acgt", "0123"), 4, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def iupac_regex(pattern: str, mode: str = "plain") -> str:
    """A regular expression of an IUPAC pattern; every other character is copied.

    mode: plain - a class has only acgt letters; subset - all target letters whose bases are
    among the pattern letter's; overlap - all that share a base with it.
    """
    out = []
    for x in pattern:
        if x not in MASK:
            out.append(x)
            continue
        if mode == "plain":
            fits = IUPAC[x]
        elif mode == "subset":
            fits = "".join(y for y, m in MASK.items() if m & MASK[x] == m)
        elif mode == "overlap":
            fits = "".join(y for y, m in MASK.items() if m & MASK[x])
        else:
            raise ValueError(f"unknown mode {mode!r}")
        out.append(fits if len(fits) == 1 else f"[{fits}]")
    return "".join(out)


def expand(pattern: str) -> list[str]:
    """All plain sequences of an IUPAC pattern."""
    out = [""]
    for x in pattern:
        out = [p + b for p in out for b in IUPAC[x]]
    return out


def expected_sites(pattern: str, fractions: list[Column], length: Column) -> Column:
    """Expected hits of pattern and its twin in a random sequence of these base fractions (a, c, g, t)."""

    def chance(p: str) -> Column:
        out = F.lit(1.0)
        for x in p:
            out = out * sum((fractions["acgt".index(b)] for b in IUPAC[x][1:]), fractions["acgt".index(IUPAC[x][0])])
        return out

    return (chance(pattern) + chance(plain_reverse_complement(pattern))) * length


def plain_reverse_complement(pattern: str) -> str:
    return pattern.translate(str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO))[::-1]


def compatible(pattern: str, target: str, mode: str = "subset") -> bool:
    """Whether two IUPAC strings of one length agree: pure (equal plain bases), overlap or subset."""
    if len(pattern) != len(target):
        return False
    for p, t in zip(pattern, target):
        both = MASK[p] & MASK[t]
        if not both or mode != "overlap" and both != MASK[t] or mode == "pure" and t not in BIT:
            return False
    return True
