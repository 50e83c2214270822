"""Codon tables, translation and reverse translation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import BY_MASK, IUPAC, MASK, _c

# The standard genetic code, codons in the order ttt ttc tta ttg tct ... ggg,
# and by table number the codons in which the other published codes differ from it.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
DIFFERENCES = {
    0: {},
    1: {"aga": "*", "agg": "*", "ata": "M", "tga": "W"},
    2: {"ata": "M", "ctt": "T", "ctc": "T", "cta": "T", "ctg": "T", "tga": "W"},
    3: {"tga": "W"},
    4: {"aga": "S", "agg": "S", "ata": "M", "tga": "W"},
    5: {"taa": "Q", "tag": "Q"},
    6: {"aaa": "N", "aga": "S", "agg": "S", "tga": "W"},
    7: {"tga": "C"},
    8: {},
    9: {"ctg": "S"},
    10: {"aga": "G", "agg": "G", "ata": "M", "tga": "W"},
    11: {"aaa": "N", "aga": "S", "agg": "S", "taa": "Y", "tga": "W"},
    12: {"tag": "Q"},
}
NAMES = {0: "Standard", 1: "Vertebrate_Mito", 2: "Yeast_Mito", 3: "Mold_Protozoan_Mito", 4: "Invertebrate_Mito", 5: "Ciliate", 6: "Echinoderm_Mito", 7: "Euplotid", 8: "Bacterial", 9: "Alt_Yeast", 10: "Ascidian_Mito", 11: "Flatworm_Mito", 12: "Blepharisma"}
THREE = {
    "A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "Q": "Gln", "E": "Glu", "G": "Gly", "H": "His", "I": "Ile", "L": "Leu",
    "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val", "*": "Ter", "X": "XXX",
}
#: Average masses of residues in dalton, and of the water that a chain adds.
RESIDUE_MASS = {
    "A": 71.0788, "R": 156.1875, "N": 114.1038, "D": 115.0886, "C": 103.1388, "Q": 128.1307, "E": 129.1155, "G": 57.0519, "H": 137.1411, "I": 113.1594, "L": 113.1594,
    "K": 128.1741, "M": 131.1926, "F": 147.1766, "P": 97.1167, "S": 87.0782, "T": 101.1051, "W": 186.2132, "Y": 163.1760, "V": 99.1326,
}
WATER_MASS = 18.01528
#: Published pK values of side chains and ends.
PK_POSITIVE = {"K": 10.5, "R": 12.5, "H": 6.0, "end": 9.69}
PK_NEGATIVE = {"D": 3.65, "E": 4.25, "C": 8.18, "Y": 10.07, "end": 2.34}


def codon_table(table: int = 0, degenerate: bool = False) -> dict[str, str]:
    """codon -> one-letter residue; degenerate: also every IUPAC codon whose expansions agree."""
    if table not in DIFFERENCES:
        raise ValueError(f"codon table {table} is not one of 0 to {max(DIFFERENCES)}")
    plain = {a + b + c: STANDARD[16 * i + 4 * j + k] for i, a in enumerate("tcag") for j, b in enumerate("tcag") for k, c in enumerate("tcag")}
    plain |= DIFFERENCES[table]
    if not degenerate:
        return plain
    out = {}
    for a in IUPAC:
        for b in IUPAC:
            for c in IUPAC:
                got = {plain[x + y + z] for x in IUPAC[a] for y in IUPAC[b] for z in IUPAC[c]}
                if len(got) == 1:
                    out[a + b + c] = got.pop()
    return out


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(entries.items()) for x in kv])


def codons(seq: Column | str, frame: int = 1) -> Column:
    """Array of the whole codons of a frame 1 to 3."""
    s = _c(seq) if frame == 1 else F.substring(_c(seq), frame, 2**31 - 1 - frame)
    return F.regexp_extract_all(s, F.lit("(...)"), F.lit(1))


def translate(seq: Column | str, frame: int = 1, table: int = 0, letters: int = 1, degenerate: bool = False) -> Column:
    """Residues of a frame: 1 to 3 on the sequence; letters 1 or 3.  Codons without one meaning are X (XXX)."""
    known = _map(codon_table(table, degenerate))
    out = F.array_join(F.transform(codons(seq, frame), lambda x: F.coalesce(F.try_element_at(known, x), F.lit("X"))), "")
    if letters == 1:
        return out
    three = _map(THREE)
    return F.array_join(F.transform(F.regexp_extract_all(out, F.lit("(.)"), F.lit(1)), lambda x: F.try_element_at(three, x)), "")


def reverse_codons(table: int = 0) -> dict[str, str]:
    """residue -> the IUPAC codon whose letters are unions over all its codons (X: nnn)."""
    masks: dict[str, list[int]] = {}
    for codon, aa in codon_table(table).items():
        held = masks.setdefault(aa, [0, 0, 0])
        for k in range(3):
            held[k] |= MASK[codon[k]]
    return {aa: "".join(BY_MASK[m] for m in held) for aa, held in masks.items()} | {"X": "nnn"}


def reverse_translate(protein: Column | str, table: int = 0) -> Column:
    known = _map(reverse_codons(table))
    return F.array_join(F.transform(F.regexp_extract_all(_c(protein), F.lit("(.)"), F.lit(1)), lambda x: F.coalesce(F.try_element_at(known, x), F.lit("nnn"))), "")


def molecular_weight(protein: Column | str) -> Column:
    """kD; residues that are not of the twenty weigh nothing."""
    p = _c(protein)
    total = F.lit(WATER_MASS)
    for aa, mass in RESIDUE_MASS.items():
        total = total + (F.length(p) - F.length(F.replace(p, F.lit(aa), F.lit("")))) * F.lit(mass)
    return total / F.lit(1000.0)


def isoelectric_point(protein: Column | str, steps: int = 24) -> Column:
    """pH at which the net charge is 0, by bisection unrolled over an array (no user function)."""
    p = _c(protein)
    n = {aa: (F.length(p) - F.length(F.replace(p, F.lit(aa), F.lit("")))).cast("double") if aa != "end" else F.lit(1.0) for aa in [*PK_POSITIVE, *PK_NEGATIVE]}
    counts = F.struct(*[n[aa].alias(f"p{aa}") for aa in PK_POSITIVE], *[n[aa].alias(f"n{aa}") for aa in PK_NEGATIVE])

    def charge(c: Column, ph: Column) -> Column:
        out = F.lit(0.0)
        for aa, pk in PK_POSITIVE.items():
            out = out + c[f"p{aa}"] / (1 + F.pow(F.lit(10.0), ph - pk))
        for aa, pk in PK_NEGATIVE.items():
            out = out - c[f"n{aa}"] / (1 + F.pow(F.lit(10.0), F.lit(pk) - ph))
        return out

    def step(state: Column, _: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / 2
        up = charge(state["c"], mid) > 0
        return F.struct(F.when(up, mid).otherwise(state["lo"]).alias("lo"), F.when(up, state["hi"]).otherwise(mid).alias("hi"), state["c"].alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(14.0).alias("hi"), counts.alias("c")), step, lambda s: (s["lo"] + s["hi"]) / 2)
