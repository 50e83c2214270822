"""Boolean rules over counts of sites: ``Name,(A:min:Max & (B | C:2)),window``.

& | ^ have no precedence: they are taken from left to right, parentheses first.
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Column

from .patterns import Pattern

MOST = 32000


@dataclasses.dataclass(frozen=True)
class Term:
    name: str
    least: int = 0
    most: int = MOST


@dataclasses.dataclass(frozen=True)
class Rule:
    name: str
    tree: object  # Term, or (left, operator, right)
    window: int

    @property
    def terms(self) -> list[Term]:
        out: dict[str, Term] = {}

        def walk(t):
            if isinstance(t, Term):
                out.setdefault(t.name, t)
            else:
                walk(t[0])
                walk(t[2])

        walk(self.tree)
        return list(out.values())

    def holds(self, counts: dict[str, Column]) -> Column:
        """The rule as an expression over a count per pattern name."""

        def build(t) -> Column:
            if isinstance(t, Term):
                return counts[t.name].between(t.least, t.most)
            a, b = build(t[0]), build(t[2])
            return a & b if t[1] == "&" else a | b if t[1] == "|" else a != b

        return build(self.tree)

    def sql(self, count: str = "n_{}") -> str:
        def build(t) -> str:
            if isinstance(t, Term):
                return f"({count.format(t.name)} BETWEEN {t.least} AND {t.most})"
            a, b = build(t[0]), build(t[2])
            return f"({a} {'AND' if t[1] == '&' else 'OR' if t[1] == '|' else '<>'} {b})"

        return build(self.tree)


def parse_expression(text: str):
    tokens = re.findall(r"[()&|^]|[^()&|^\s]+", text)
    at = 0

    def operand():
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"rule {text!r} ends early")
        token = tokens[at]
        at += 1
        if token == "(":
            out = expression()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"rule {text!r} lacks a closing parenthesis")
            at += 1
            return out
        if token in ")&|^":
            raise ValueError(f"{token!r} is misplaced in rule {text!r}")
        name, *limits = token.split(":")
        return Term(name, int(limits[0]) if limits and limits[0] else 0, int(limits[1]) if len(limits) > 1 and limits[1] else MOST)

    def expression():
        nonlocal at
        out = operand()
        while at < len(tokens) and tokens[at] in "&|^":
            op = tokens[at]
            at += 1
            out = (out, op, operand())
        return out

    out = expression()
    if at != len(tokens):
        raise ValueError(f"rule {text!r} has more after its end")
    return out


def parse_rule(text: str) -> Rule:
    text = re.sub(r"\s", "", text)
    m = re.fullmatch(r"([^,]+),(.*),(\d+)", text)
    if not m or int(m[3]) < 1:
        raise ValueError(f"rule {text!r} is not Name,(expression),window")
    return Rule(m[1], parse_expression(m[2]), int(m[3]))


def parse_rules_file(text: str) -> list[Rule]:
    """Rules after the line ``..``; ``;`` begins a comment line, a backslash joins the next line."""
    body = re.split(r"^\.\.[ \t]*$", text, maxsplit=1, flags=re.M)[-1]
    lines = [x for x in re.sub(r"\\\s*\n", "", "\n".join(x for x in body.split("\n") if not x.startswith(";"))).split("\n") if x.strip()]
    return [parse_rule(x) for x in lines]


def bounded(patterns: list[Pattern], rules: list[Rule]) -> list[Pattern]:
    """Patterns with the least and most hits of the first rule term that names them (whatever its case)."""
    first: dict[str, Term] = {}
    for r in rules:
        for t in r.terms:
            first.setdefault(t.name.lower(), t)
    return [dataclasses.replace(p, min_hits=first[p.name.lower()].least, max_hits=first[p.name.lower()].most) if p.name.lower() in first else p for p in patterns]
