"""The pattern compiler: sites with cuts, twins, mismatch variants, seeds, keys, filters and selections."""

from __future__ import annotations

import dataclasses
import itertools
import re

from ..functions.sequence import IUPAC, MASK, iupac_regex, plain_reverse_complement

MAX_ERRORS = 4


@dataclasses.dataclass(frozen=True)
class Pattern:
    """One site.  top_cut: bases before the cut of the top strand; overhang: > 0 five-prime, < 0 three-prime, 0 blunt."""

    name: str
    site: str
    top_cut: int = 0
    overhang: int = 0
    errors: int = 0
    dam: int = 100
    dcm: int = 100
    units: int = 0
    price: int = 0
    min_hits: int = 1
    max_hits: int = 32000
    kind: str = "re"

    @property
    def length(self) -> int:
        return len(self.site)

    @property
    def twin(self) -> str:
        return plain_reverse_complement(self.site)

    @property
    def is_palindrome(self) -> bool:
        return self.site == self.twin

    @property
    def magnitude(self) -> float:
        return sum({1: 1.0, 2: 0.5, 3: 0.25, 4: 0.0}[len(IUPAC[x])] for x in self.site)

    @property
    def cost(self) -> int:
        return self.units // self.price if self.price else 0

    @property
    def bottom_cut(self) -> int:
        """From a bottom-strand match's start to its coordinate."""
        return self.length - self.top_cut - self.overhang

    def strands(self) -> list[tuple[int, str, int]]:
        """(strand, site as read on the top strand, offset of the coordinate from the match's start)."""
        out = [(1, self.site, self.top_cut)]
        if not self.is_palindrome:
            out.append((-1, self.twin, self.bottom_cut))
        return out


def clean_site(raw: str, top_cut: int) -> tuple[str, int]:
    """A raw site without cut marks, lower-case, without outer n; the cut moves with the n dropped in front."""
    site = re.sub(r"['_]", "", raw).lower().replace("u", "t")
    if bad := set(site) - set(IUPAC):
        raise ValueError(f"site {raw!r} has letters {sorted(bad)}")
    front = len(site) - len(site.lstrip("n"))
    return site.strip("n"), top_cut - front


def pattern(name: str, raw_site: str, top_cut: int | None = None, overhang: int = 0, **more) -> Pattern:
    """From a raw site such as G'AATT_C: without top_cut the marks give cut and overhang."""
    if top_cut is None:
        top = raw_site.replace("_", "").find("'")
        bottom = raw_site.replace("'", "").find("_")
        top_cut = max(top, 0)
        overhang = (bottom - top if bottom >= 0 and top >= 0 else 0) or overhang
    site, top_cut = clean_site(raw_site, top_cut)
    if not site:
        raise ValueError(f"pattern {name} has no site")
    if not 0 <= more.get("errors", 0) <= MAX_ERRORS:
        raise ValueError(f"errors of {name} must be 0 to {MAX_ERRORS}")
    return Pattern(name, site, top_cut, overhang, **more)


def command_line_pattern(text: str) -> Pattern:
    """``Name,Pattern[,Errors]``: the cut is at the start of a top match."""
    name, site, *errors = [x.strip() for x in text.split(",")]
    return pattern(name, site, 0, 0, errors=int(errors[0]) if errors else 0, kind="cmdline")


def variants(site: str, errors: int) -> list[str]:
    """The site with up to ``errors`` positions as n, one per distinct choice that no shorter choice covers."""
    if errors <= 0:
        return [site]
    places = [i for i, x in enumerate(site) if x != "n"]
    n = min(errors, len(places))
    return sorted({"".join("n" if i in some else x for i, x in enumerate(site)) for some in map(set, itertools.combinations(places, n))})


def site_regex(site: str, errors: int = 0, mode: str = "plain") -> str:
    """A regular expression for a site with mismatches (substitutions only)."""
    some = variants(site, errors)
    return iupac_regex(some[0], mode) if len(some) == 1 else "(?:" + "|".join(iupac_regex(v, mode) for v in some) + ")"


def best_seed(site: str, width: int = 6) -> tuple[int, str]:
    """(offset, word): the leftmost window of greatest magnitude; a shorter site is padded with n."""
    site = site.ljust(width, "n")
    weight = {1: 1.0, 2: 0.5, 3: 0.25, 4: 0.0}
    at = max(range(len(site) - width + 1), key=lambda i: (sum(weight[len(IUPAC[x])] for x in site[i : i + width]), -i))
    return at, site[at : at + width]


def passes(p: Pattern, magnitude: float | None = None, overhang: str | None = None, overhang_length: int | None = None, cost: int | None = None) -> bool:
    """One predicate for all filters.  overhang: "5", "3", "1" (any) or "0" (blunt)."""
    if p.kind == "regex":
        return True
    if magnitude is not None and p.magnitude < magnitude:
        return False
    if overhang == "5" and p.overhang <= 0 or overhang == "3" and p.overhang >= 0 or overhang == "0" and p.overhang != 0:
        return False
    if overhang_length is not None and abs(p.overhang) != overhang_length:
        return False
    return cost is None or p.cost >= cost


def select(patterns: list[Pattern], names: list[str]) -> list[Pattern]:
    """Patterns by name, whatever its case; a name that is not there is an error."""
    by = {p.name.lower(): p for p in patterns}
    if missing := [n for n in names if n.lower() not in by]:
        raise KeyError(f"no such patterns: {', '.join(missing)}")
    return [by[n.lower()] for n in names]


def overlaps(a: str, b: str) -> bool:
    return len(a) == len(b) and all(MASK[x] & MASK[y] for x, y in zip(a, b))


#: The methylases' own sites.
DAM = Pattern("dam", "gatc")
DCM = Pattern("dcm", "ccwgg")

#: A small set of well-known enzymes for queries and tests; whole databases are read from files.
DEMO = [
    pattern("HinfI", "G'ANT_C", units=10000, price=100),
    pattern("TaqI", "T'CG_A", dam=3, units=4000, price=50),
    pattern("RsaI", "GT'AC", units=1000, price=40),
    pattern("MseI", "T'TA_A", units=500, price=60),
    pattern("EcoRI", "G'AATT_C", units=10000, price=50),
    pattern("AluI", "AG'CT", units=500, price=50),
    pattern("HaeIII", "GG'CC", dcm=2, units=3000, price=45),
    pattern("MboI", "'GATC_", dam=0, units=500, price=50),
    pattern("NlaIII", "_CATG'", units=500, price=55),
    pattern("BsmAI", "GTCTC", 6, 4, units=1000, price=50),
    pattern("HindIII", "A'AGCT_T", units=10000, price=50),
]
