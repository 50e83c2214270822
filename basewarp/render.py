"""Text and HTML reports of small result tables: maps, ladders, gels, sites, and a plasmid drawing."""

from __future__ import annotations

import html
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that table() takes to the driver; it says so when there are more.  Maps, ladders and gels are whole: their rows are
#: streamed, partition by partition.
ROWS = 10_000


def _rows(df: DataFrame, limit: int = ROWS) -> tuple[list, bool]:
    got = df.limit(limit + 1).collect()
    return got[:limit], len(got) > limit


def table(df: DataFrame, title: str) -> str:
    """Any table as aligned columns."""
    rows, more = _rows(df)
    cells = [df.columns, *[["" if x is None else str(x) for x in r] for r in rows]]
    width = [max(len(c[k]) for c in cells) for k in range(len(df.columns))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(c, width)).rstrip() for c in cells]
    return "\n".join([f"== {title}", *lines, *(["... more rows follow"] if more else [])]) + "\n"


def linear_map(lines: DataFrame, strands: int = 2, tics: bool = True, number_from: int = 1) -> str:
    """Rows of operators.derive.linear_map as text, block by block."""
    out = []
    for r in lines.orderBy("seq_id", "block_no").toLocalIterator():
        at = r["begin"] + number_from - 1
        marks = [" "] * len(r["bases"])
        for label in r["labels"].split():
            k = int(label.rsplit(":", 1)[1]) - r["begin"]
            if 0 <= k < len(marks):
                marks[k] = "\\"
        out += [*([r["labels"], "".join(marks)] if r["labels"] else []), f"{r['bases']}  {at + len(r['bases']) - 1}"]
        if tics:
            out.append("".join("|" if (at + k) % 10 == 0 else "." for k in range(len(r["bases"]))))
        if strands == 2:
            out.append(r["other"])
        out.append("")
    return "\n".join(out)


def ladder(cells: DataFrame, width: int) -> str:
    """Rows of operators.derive.ladder_cells (one sequence) as lanes."""
    lanes: dict[str, list[str]] = {}
    for r in cells.orderBy("pat", "cell").toLocalIterator():
        lane = lanes.setdefault(r["pat"], ["-"] * width)
        lane[min(width - 1, r["cell"])] = r["mark"]
    return "\n".join(f"{name:>12} {''.join(lane)}" for name, lane in lanes.items())


def gel(cells: DataFrame, width: int) -> str:
    """Rows of operators.derive.gel_cells (one sequence) as lanes."""
    lanes: dict[str, list[str]] = {}
    for r in cells.orderBy("pat", "cell").toLocalIterator():
        lane = lanes.setdefault(r["pat"], [" "] * (width + 1))
        lane[r["cell"]] = "|" if r["n"] == 1 else str(r["n"]) if r["n"] <= 9 else "*"
    return "\n".join(f"{name:>12} {''.join(lane)}" for name, lane in lanes.items())


def proximity_ladder(sites: DataFrame, pairs: DataFrame, a: str, b: str, width: int) -> DataFrame:
    """Four lanes of cells: all sites of a, those in a pair, those of b in a pair, all of b."""
    length = sites.select("seq_id", "seq_len").distinct()
    lane = lambda name, df: df.select("seq_id", F.lit(name).alias("pat"), "site").distinct()
    four = lane("1 " + a, sites.where(F.col("pat") == a)).unionByName(lane("2 " + a + " near", pairs.select("seq_id", F.col("site_a").alias("site"))))
    four = four.unionByName(lane("3 " + b + " near", pairs.select("seq_id", F.col("site_b").alias("site")))).unionByName(lane("4 " + b, sites.where(F.col("pat") == b)))
    from .operators.derive import ladder_cells

    return ladder_cells(four.join(length, "seq_id"), width)


def page(parts: list[tuple[str, str]], title: str = "Report") -> str:
    """Reports as one HTML page with a table of contents."""
    toc = "".join(f'<li><a href="#s{k}">{html.escape(name)}</a></li>' for k, (name, _) in enumerate(parts))
    body = "".join(f'<h2 id="s{k}">{html.escape(name)}</h2><pre>{html.escape(text)}</pre>' for k, (name, text) in enumerate(parts))
    return f"<!doctype html><html><head><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><ul>{toc}</ul>{body}</body></html>"


def plasmid(angles: DataFrame, name: str, length: int, labels: int = 180) -> str:
    """Rows of operators.derive.plasmid_angles (one sequence) as a PostScript circle with a label per site; it says so when there are more."""
    rows, more = _rows(angles.orderBy("angle", "pat"), labels)
    out = ["%!PS-Adobe-3.0", "%%BoundingBox: 0 0 612 792", "/Helvetica findfont 8 scalefont setfont", "306 396 180 0 360 arc stroke", f"270 392 moveto ({name} {length} bp) show"]
    for r in rows:
        turn = math.radians(90 - r["angle"] / 1000)
        x, y = math.cos(turn), math.sin(turn)
        out.append(f"{306 + 180 * x:.1f} {396 + 180 * y:.1f} moveto {306 + 195 * x:.1f} {396 + 195 * y:.1f} lineto stroke")
        out.append(f"{306 + 200 * x:.1f} {396 + 200 * y:.1f} moveto ({r['pat']} {r['site']}) show")
    out += ["36 36 moveto (... more sites follow) show"] if more else []
    return "\n".join([*out, "showpage", ""])


def postscript_ladder(cells: DataFrame, width: int) -> str:
    """Rows of operators.derive.ladder_cells (one sequence) as PostScript lanes."""
    lanes: dict[str, list] = {}
    for r in cells.orderBy("pat", "cell").toLocalIterator():
        lanes.setdefault(r["pat"], []).append(r)
    out = ["%!PS-Adobe-3.0", "/Courier findfont 8 scalefont setfont"]
    for k, (name, own) in enumerate(lanes.items()):
        y = 740 - 14 * k
        out += [f"36 {y} moveto ({name}) show", f"110 {y} moveto 560 {y} lineto stroke"]
        out += [f"{110 + 450 * r['cell'] / width:.1f} {y - 4} moveto 0 8 rlineto stroke" for r in own]
    return "\n".join([*out, "showpage", ""])
