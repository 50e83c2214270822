"""Regular expressions as automata over chunks of any number.

Where a match begins is told by the reversed expression, read from the right: a base begins a match
if the reversed expression, started anew at every base, accepts there.  The automaton's state is all that a chunk
needs to know of what lies right of it, so a chunk's summary is the state that it leaves for each
state it may be entered with; composed from right to left, summaries give every chunk its entry, and each chunk is read
once more for its hits.  Time is linear in the bases, whatever an expression's matches span and
however many there are.

The rows of a batch are read in step: one look-up in the table of states moves all of them by a base.
"""

from __future__ import annotations

import re

import numpy as np

from ..functions.sequence import COMPLEMENT_FROM, COMPLEMENT_TO, LETTERS

#: States of a table, and letters of an expression once repeats are written out; beyond, there is no automaton.
MOST_STATES, MOST_POSITIONS = 4096, 4096

_parser = re._parser
CODE = np.full(256, len(LETTERS), dtype=np.uint8)
CODE[[ord(x) for x in LETTERS]] = range(len(LETTERS))
#: The code of each code's complement.
TWIN = np.array([LETTERS.index(COMPLEMENT_TO[COMPLEMENT_FROM.index(x)]) for x in LETTERS] + [len(LETTERS)], dtype=np.uint8)
_SYMBOLS = len(LETTERS) + 1  # the last stands for every other character
_EVERY = (1 << _SYMBOLS) - 1


class TooLarge(ValueError):
    """The expression has no automaton of bounded size, or uses what automata can't do."""


class _Positions:
    """First, last and following positions of an expression read from the right (sets as bits)."""

    def __init__(self):
        self.fits: list[int] = []
        self.follow: list[int] = []

    def single(self, symbols: int):
        if len(self.fits) >= MOST_POSITIONS:
            raise TooLarge("too many letters")
        self.fits.append(symbols)
        self.follow.append(0)
        bit = 1 << len(self.fits) - 1
        return bit, bit, False

    def then(self, a, b):
        for p in _bits(a[1]):
            self.follow[p] |= b[0]
        return a[0] | (b[0] if a[2] else 0), b[1] | (a[1] if b[2] else 0), a[2] and b[2]

    def build(self, items):
        out = (0, 0, True)
        for kind, value in reversed(list(items)):  # from the right
            out = self.then(out, self.item(str(kind), value))
        return out

    def item(self, kind: str, value):
        if kind == "LITERAL":
            return self.single(_symbol(value))
        if kind == "NOT_LITERAL":
            return self.single(_EVERY & ~_symbol(value) | 1 << len(LETTERS))
        if kind == "ANY":
            return self.single(_EVERY)
        if kind == "IN":
            return self.single(_class(value))
        if kind == "SUBPATTERN":
            return self.build(value[3])
        if kind == "ATOMIC_GROUP" or kind == "POSSESSIVE_REPEAT":
            raise TooLarge("possessive parts need a look at what they have taken")
        if kind == "BRANCH":
            parts = [self.build(x) for x in value[1]]
            return _union(p[0] for p in parts), _union(p[1] for p in parts), any(p[2] for p in parts)
        if kind in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = value
            out = (0, 0, True)
            for _ in range(least):
                out = self.then(out, self.build(inner))
            if most == _parser.MAXREPEAT:
                loop = self.build(inner)
                for p in _bits(loop[1]):
                    self.follow[p] |= loop[0]
                return self.then(out, (loop[0], loop[1], True))
            if most - least > MOST_POSITIONS:
                raise TooLarge("too many letters")
            rest = (0, 0, True)
            for _ in range(most - least):  # (x(x(x)?)?)?
                one = self.then(rest, self.build(inner)) if rest[0] else self.build(inner)
                rest = (one[0], one[1] | rest[1], True)
            return self.then(out, rest)
        raise TooLarge(f"{kind} has no automaton")


def _bits(x: int):
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def _union(sets) -> int:
    out = 0
    for x in sets:
        out |= x
    return out


def _symbol(code: int) -> int:
    if chr(code) not in LETTERS:
        raise TooLarge(f"{chr(code)!r} is no letter of sequences")
    return 1 << LETTERS.index(chr(code))


def _class(items) -> int:
    out, negate = 0, False
    for kind, value in items:
        if str(kind) == "NEGATE":
            negate = True
        elif str(kind) == "LITERAL":
            out |= _symbol(value)
        elif str(kind) == "RANGE":
            out |= _union(1 << k for k, x in enumerate(LETTERS) if value[0] <= ord(x) <= value[1])
        else:
            raise TooLarge(f"{kind} in a class")
    return _EVERY & ~out if negate else out


class Automaton:
    """table[state, symbol]: the next state, state 0 the one right of a sequence's end; accepts[state]: a match begins at the base just read."""

    def __init__(self, regex: str):
        tree = _parser.parse(regex)
        if tree.state.flags & ~re.UNICODE.value or tree.state.groupdict:
            raise TooLarge("flags and names")
        positions = _Positions()
        first, last, empty = positions.build(tree)
        sets, numbers, rows = [0], {0: 0}, []
        fitting = [_union(1 << p for p, f in enumerate(positions.fits) if f >> s & 1) for s in range(_SYMBOLS)]
        for held in sets:  # grows
            near = first | _union(positions.follow[p] for p in _bits(held))
            row = []
            for s in range(_SYMBOLS):
                to = near & fitting[s]
                if to not in numbers:
                    if len(sets) >= MOST_STATES:
                        raise TooLarge("too many states")
                    numbers[to] = len(sets)
                    sets.append(to)
                row.append(numbers[to])
            rows.append(row)
        self.table = np.array(rows, dtype=np.int32)
        self.accepts = np.array([empty or held & last != 0 for held in sets])
        if empty:
            self.accepts[:] = True

    def starts(self, codes: np.ndarray, offsets: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place from 0) of the bases of each row at which a match begins; entry: the state right of each row."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        ends, state = offsets[1:][order], entry[order].astype(np.int32)
        many = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")  # rows that are longer than t
        flat, width = self.table.ravel(), _SYMBOLS
        rows, places = [], []
        for t, n in enumerate(many.tolist()):
            at = ends[:n] - (1 + t)
            now = flat[state[:n] * width + codes[at]]
            state[:n] = now
            hit = np.flatnonzero(self.accepts[now])
            if len(hit):
                rows.append(order[hit])
                places.append(at[hit])
        if not rows:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        row = np.concatenate(rows)
        return row, np.concatenate(places) - offsets[row]

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The state left of a chunk for each state right of it.  States soon run together, so few are followed for long."""
        follow, of = np.arange(len(self.table), dtype=np.int32), None
        flat, rows, at, step = self.table.ravel(), self.lists, len(codes), 1
        while at > 0:
            part = codes[max(0, at - step) : at][::-1].tolist()
            at -= step
            if len(follow) > 16:
                for c in part:
                    follow = flat[follow * _SYMBOLS + c]
            else:  # few are faster one by one
                ends = []
                for state in follow.tolist():
                    for c in part:
                        state = rows[state][c]
                    ends.append(state)
                follow = np.array(ends, dtype=np.int32)
            follow, back = np.unique(follow, return_inverse=True)
            of = back if of is None else back[of]
            step = min(2 * step, 1024)
        return follow if of is None else follow[of].astype(np.int32)

    @property
    def lists(self) -> list[list[int]]:
        if not hasattr(self, "_lists"):
            self._lists = self.table.tolist()
        return self._lists


def automaton(regex: str) -> Automaton | None:
    """The expression's automaton, None if it has none of bounded size."""
    try:
        return Automaton(regex)
    except (TooLarge, re.error, OverflowError, RecursionError):
        return None
