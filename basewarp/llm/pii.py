"""PII: base expressions, and bootstrapped contextual extraction on top of them.

1. One pass finds the base spans of every text, and candidates outside base spans:
   white-space runs with a digit or an at sign, six characters or more; and numbers of
   several groups of digits joined by blanks, brackets, dots, hyphens or slashes on one line
   (0800 7711 22, (555) 123-4567), six digits or more.  More than ``MOST_DIGITS`` digits,
   the most that a kind has, are cut into numbers of at most that many.  A number's first
   groups, last groups and single runs are its parts: they are candidates too, but do
   not count against a pattern.  Base spans are seed instances; each seed and candidate
   yields lexical patterns (the two and the three tokens before it; the token before and the one after
   it; a token is a word, lower-cased, or a punctuation mark), from outside the whole number, its brackets and quotes.
2. Spark scores the pattern-instance graph: a pattern's confidence for a kind is the mean
   score of its distinct instances, counted only if ``SUPPORT`` or more of them are seeds or,
   from the second round on, found with ``LEAST_SCORE`` or more; an instance's score for a
   kind is 1 minus the product of (1 - confidence) over its patterns (seeds stay 1).  So
   in each of the ``ROUNDS`` rounds found instances support patterns that no seed has.
3. Candidates whose best score reaches ``LEAST_SCORE`` become spans of that kind; of a
   number and its parts the longest of these stay that don't overlap.

Besides the four base kinds there is a fifth, secret (keys, tokens).  Values of 24 characters or more after ``=`` or ``:``
are likely ones if they change between letters and digits ``LEAST_SWITCHES`` times or more.  Of these only the surest,
with ``SEED_SWITCHES`` or more, and keys with a published prefix are seeds; the others are candidates like any number, for
contexts to find, as are values that look otherwise.  n_learned counts the spans that came out of the graph.  A likely
value that no context vouches for is still reported, as the rule alone says so.

Texts are read once; the graph has only identifiers and their contexts, grouped by
pattern and by instance with map-side sums.  Defined results: null text is empty; equal
scores go to the kind listed first; repeated rows are marked each; an empty table gives an
empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, id_and_text, task, written

#: The kinds of the contract, and the method's own after them.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
SUPPORT, ROUNDS, LEAST_SCORE = 3, 3, 0.75

#: Fixed patterns of the contract.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: A value that is assigned, and keys whose prefix tells them.
_VALUE = re.compile(r"[=:]\x20?[\"']?([A-Za-z0-9_+-]{24,}={0,2})")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20}|xox[abps]-[0-9A-Za-z-]{20,}|[rs]k_live_[0-9A-Za-z]{20,})(?![A-Za-z0-9])")
_KEY_SIGN = re.compile(r"A[KS]IA|gh[opsu]_|github_pat_|glpat-|xox[abps]-|[rs]k_live_")
_SWITCH = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")
LEAST_SWITCHES, SEED_SWITCHES = 6, 18

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SIGN = re.compile(r"[0-9@]")
_RUN = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"\w+|[^\w\s]")

#: Numbers in groups: a group, and what may lie between the digits of two groups.
_GROUP = re.compile(r"\+?[(\[]*[0-9][0-9().\[\]/\u2010-\u2013-]*")
_JOIN = re.compile(r"[\x20\t\xa0\u2009\u202f().\[\]/\u2010-\u2013-]*")
LEAST_DIGITS, MOST_DIGITS = 6, 19
_OPENING, _CLOSING = " \t\r\n+([{<\"'", " \t\r\n)]}>\"'"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@`` and a domain, found from the at signs."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            end = m.end()
            out.append((lo, end))
        at = text.find("@", max(at + 1, end))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order."""
    if not _SIGN.search(text):
        return []
    out = [(a, 0, z) for a, z in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def secrets(text: str, seed_switches: int = SEED_SWITCHES) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Seeds of the method's own kind, and likely values that are none, both as base_spans has them."""
    sure, likely = set(), set()
    if "=" in text or ":" in text:
        for m in _VALUE.finditer(text):
            switches = len(_SWITCH.findall(m.group(1)))
            if switches >= LEAST_SWITCHES:
                (sure if switches >= seed_switches else likely).add((m.start(1), 4, m.end(1)))
    if _KEY_SIGN.search(text):
        keys = {(m.start(), 4, m.end()) for m in _KEY.finditer(text)}
        held = [(a, z) for a, _, z in sure | likely]
        sure |= {k for k in keys if not any(a < k[2] and k[0] < z for a, z in held)}
    return sorted(sure), sorted(likely)


def _patterns(text: str, start: int, end: int) -> list[str]:
    """Contexts of the span: two and three tokens before it, and one token on either side; brackets and quotes around it are its own."""
    lo = max(0, start - 80)
    before = _TOKEN.findall(text[lo:start].rstrip(_OPENING).lower())
    if lo and before:
        before = before[1:]  # maybe cut
    after = _TOKEN.findall(text[end : end + 60].lstrip(_CLOSING).lower())[:1]
    out = [" ".join([*before[-n:], "_"]) for n in (2, 3) if len(before) >= n]
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


def _runs(text: str, spans: list[tuple[int, int, int]]):
    """White-space runs with a digit or at sign outside all spans: (start, end) stripped of punctuation, and (start, end) whole."""
    done, k = 0, 0
    inner = sorted((a, z) for a, _, z in spans)
    for m in _RUN.finditer(text):
        if m.start() < done:
            continue
        lo, hi = m.start(), m.end()
        while lo > done and not text[lo - 1].isspace():
            lo -= 1
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        done = hi
        whole = lo, hi
        while lo < hi and not text[lo].isalnum():
            lo += 1
        while hi > lo and not text[hi - 1].isalnum():
            hi -= 1
        while k < len(inner) and inner[k][1] <= lo:
            k += 1
        if not any(a < hi and lo < z for a, z in inner[k : k + 4]):
            yield lo, hi, *whole


def _opened(text: str, lo: int, hi: int, least: int) -> int:
    """Start of the number lo to hi with its plus sign and the brackets that close within it."""
    open_, unpaired = 0, 0
    for c in text[lo:hi]:
        if c in "([":
            open_ += 1
        elif c in ")]":
            open_, unpaired = max(0, open_ - 1), unpaired + (not open_)
    while lo > least and unpaired > 0 and text[lo - 1] in "([":
        lo, unpaired = lo - 1, unpaired - 1
    return lo - 1 if lo > least and text[lo - 1] == "+" else lo


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """(start, end, start of the number it is of, whether it is only a part of that): single runs of six characters or more and numbers of several groups, outside all spans."""
    out: list[tuple[int, int, int, bool]] = []
    number: list[tuple[int, int, int, int]] = []  # groups: start, end, start of the run, digits
    held = 0  # digits of number

    def close() -> None:
        if len(number) == 1:
            lo, hi, _, _ = number[0]
            if hi - lo >= 6:
                out.append((lo, hi, lo, False))
        elif number:
            n = len(number)
            # the whole number first, then its first groups, its last groups, and single runs
            parts = [(0, n), *((0, j) for j in range(n - 1, 1, -1)), *((i, n) for i in range(1, n - 1))]
            at = number[0][0]
            whole = held >= LEAST_DIGITS
            for i, j in parts:
                if sum(g[3] for g in number[i:j]) >= LEAST_DIGITS:
                    out.append((_opened(text, number[i][0], number[j - 1][1], number[i][2]), number[j - 1][1], at, (i, j) != (0, n)))
            out.extend((lo, hi, at, whole) for lo, hi, _, _ in number if hi - lo >= 6)
        number.clear()

    for lo, hi, left, right in _runs(text, spans):
        g = _GROUP.match(text, _opened(text, lo, hi, left)) if lo < hi else None
        digits = sum(c in "0123456789" for c in text[lo:hi]) if g and g.end() >= hi else 0
        joined = number and digits and held + digits <= MOST_DIGITS and _JOIN.match(text, number[-1][1], lo).end() == lo
        if not joined:
            close()
            held = 0
        if digits:
            number.append((lo, hi, left, digits))
            held += digits
        elif hi - lo >= 6:
            out.append((lo, hi, lo, False))
    close()
    return out


_FOUND = pa.schema(
    [
        ("uid", pa.int64()),
        ("doc_id", pa.int64()),
        *((f"n_{k}", pa.int64()) for k in BASE),
        ("base_sha256", pa.string()),
        ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
        ("likely", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
        ("seen", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("number", pa.int64()), ("part", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))),
    ]
)
_FOUND_SQL = "uid long, doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, base array<struct<start:long,kind:int,end:long>>, likely array<struct<start:long,kind:int,end:long>>, seen array<struct<start:long,kind:int,end:long,number:long,part:boolean,instance:string,patterns:array<string>>>"


def _finder(seed_switches: int):
    def find(batches):
        uid = TaskContext.get().partitionId() << 36
        as_rows = lambda spans: [{"start": a, "kind": k, "end": z} for a, k, z in spans]
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                text = text or ""
                base = base_spans(text)
                sure, likely = secrets(text, seed_switches)
                seeds = sorted(base + sure)
                seen = [(a, k, z, a, False) for a, k, z in seeds] + [(a, -1, z, a, False) for a, _, z in likely]
                if _SIGN.search(text):
                    seen += [(a, -1, z, at, part) for a, z, at, part in candidates(text, sorted(seeds + likely))]
                seen = [{"start": a, "kind": k, "end": z, "number": at, "part": part, "instance": text[a:z], "patterns": _patterns(text, a, z)} for a, k, z, at, part in seen]
                said = ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in base)
                rows.append((uid, doc, *(sum(s[1] == k for s in base) for k in range(4)), hashlib.sha256(said.encode()).hexdigest(), as_rows(seeds), as_rows(likely), [s for s in seen if s["patterns"]]))
                uid += 1
            columns = zip(*rows) if rows else [[]] * len(_FOUND)
            yield batch_of(_FOUND, **{f.name: list(c) for f, c in zip(_FOUND, columns)})

    return find


def learned(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, least: float = LEAST_SCORE) -> DataFrame:
    """(instance, kind, score) of the candidates that the scored graph accepts.

    Both sides of its joins grow with the corpus, so none is broadcast; AQE splits the partitions of frequent patterns.
    """
    occ = found.select(F.explode("seen").alias("s")).select("s.instance", "s.kind", "s.part", F.explode("s.patterns").alias("pattern"))
    edges = written(occ.groupBy("pattern", "instance", "kind").agg(F.min("part").alias("part")), "contexts")
    seeds = edges.where("kind >= 0").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    links = edges.groupBy("pattern", "instance").agg(F.min("part").alias("part"))
    whole = links.where("NOT part").drop("part")
    known = seeds
    for _ in range(rounds):
        n = whole.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
        # A kind counts with SUPPORT seeds or found instances; unknown instances count as 0.
        got = whole.join(known.hint("merge"), "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.sum((F.col("score") >= least).cast("int")).alias("found")).where(F.col("found") >= support)
        confidence = got.join(n.hint("merge"), "pattern").select("pattern", "kind", F.least(F.lit(0.999), F.col("s") / F.col("n")).alias("confidence"))
        scored = links.join(confidence.hint("merge"), "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        known = seeds.unionByName(scored.join(seeds.select("instance").distinct().hint("merge"), "instance", "left_anti"))
    best = known.join(seeds.select("instance").distinct().hint("merge"), "instance", "left_anti").where(F.col("score") >= least)
    return best.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b")).select("instance", (-F.col("b.k")).alias("kind"), F.col("b.score").alias("score"))


def pii(docs: DataFrame, seed_switches: int = SEED_SWITCHES, by_rule: bool = True) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (base, secrets and learned), n_spans, n_learned.

    by_rule: also report likely secrets that no context vouches for.
    """
    found = written(id_and_text(docs).mapInArrow(task("pii", _finder(seed_switches)), _FOUND_SQL), "spans")
    good = written(learned(found), "learned")
    more = found.select("uid", F.explode("seen").alias("s")).where("s.kind < 0").select("uid", "s.start", "s.end", "s.number", F.col("s.instance").alias("instance"))
    # Of a number and its parts: the longest first, then those that don't overlap it.
    more = more.join(good.hint("merge"), "instance").groupBy("uid", "number").agg(F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("size"), "start", F.col("kind").cast("int").alias("kind"), "end"))).alias("accepted"))
    overlap = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    apart = F.aggregate("accepted", F.slice("accepted", 1, 0), lambda had, x: F.when(F.exists(had, lambda y: overlap(x, y)), had).otherwise(F.array_append(had, x)))
    more = more.select("uid", F.explode(apart).alias("x")).groupBy("uid").agg(F.collect_list(F.struct("x.start", "x.kind", "x.end")).alias("more"))
    joined = found.drop("seen").join(more, "uid", "left").withColumn("more", F.coalesce("more", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    rest = F.filter("likely", lambda x: ~F.exists("more", lambda y: overlap(x, y))) if by_rule else F.slice("likely", 1, 0)
    all_spans = F.array_sort(F.concat("base", "more", rest))
    said = F.concat_ws(",", F.transform(all_spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))
    return joined.select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", said.alias("spans"), F.size(all_spans).cast("long").alias("n_spans"), F.size("more").cast("long").alias("n_learned"))
