"""Glyph runs: where the characters of a text stand on a page.

A run is ``[header, page, x1, y1, x2, y2, width or [gap, width] ...]``; bits of the header tell a trailing
soft hyphen, the direction of the axis and right-to-left text.  The functions work on decoded runs, inside
Arrow batches; ``*_col`` are Spark expressions on runs as structs.
"""

from __future__ import annotations

import json
import math
from itertools import accumulate
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of a run's header, and the tolerance of comparisons.
SOFT_HYPHEN, AXIS_SHIFT, RIGHT_TO_LEFT, EPS = 1, 1, 8, 1e-3
#: The most that a rounded value of a run may be off.
MAX_ERROR = 0.25


def axis(header: int) -> int:
    return (header >> AXIS_SHIFT) & 3


def vertical(axis_dir: int | None) -> bool:
    return axis_dir in (1, 3)


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def parse_runs(text: str | None) -> list:
    """The runs of a text map; none for anything that is no JSON array."""
    try:
        runs = json.loads(text) if isinstance(text, str) else []
    except ValueError:
        return []
    return runs if isinstance(runs, list) else []


def positions(run) -> list[tuple[float, float]]:
    """(from, to) of a run's characters along its axis; a run without widths is one character."""
    if not isinstance(run, list) or len(run) < 6:
        return []
    upright = vertical(axis(run[0]))
    at, end = (run[3], run[5]) if upright else (run[2], run[4])
    if len(run) == 6:
        return [(at, end)]
    out = []
    for w in run[6:]:
        gap, width = w if isinstance(w, list) else (0, w)
        at += gap
        out.append((at, at + width))
        at += width
    return out


def glyph_boxes(runs: list) -> list[tuple[list[float], int]]:
    """(rectangle, page) of every character that shows; soft hyphens of the layout do not."""
    out = []
    for run in runs:
        if not isinstance(run, list) or len(run) < 6:
            continue
        header, page, x1, y1, x2, y2 = run[:6]
        spans = positions(run)
        if header & SOFT_HYPHEN:
            spans = spans[:-1]
        for a, b in spans:
            if _number(a) and _number(b):
                out.append(([x1, a, x2, b] if vertical(axis(header)) else [a, y1, b, y2], page))
    return out


def boxes_of_text(text_units: list[str], runs: list) -> list[tuple[list[float], int] | None]:
    """The box of every UTF-16 unit: blanks, tabs and newlines have none and use up none."""
    boxes = iter(glyph_boxes(runs))
    return [None if u in " \n\t" else next(boxes, None) for u in text_units]


def half_up(value: float, digits: int) -> float:
    f = 10**digits
    return math.floor(value * f + 0.5) / f


def shortest(value: float, error: float) -> float:
    """The decimal of fewest digits, 0 to 6, within the error; the value itself if none is."""
    if not _number(value):
        return value
    return next((r for r in (half_up(value, digits) for digits in range(7)) if abs(r - value) <= error + 1e-9), value)


def compact(run, error: float = MAX_ERROR):
    """A run with rounded numbers; what rounding shifts is made good at the next number."""
    if not isinstance(run, list) or len(run) < 6:
        return run
    box = [shortest(v, error) for v in run[2:6]]
    # gaps and widths one after the other, each with the least it may become
    numbers = [n for w in run[6:] for n in (((w[0], -math.inf), (w[1], 0)) if isinstance(w, list) else ((w, 0),))]

    def step(last: tuple, number: tuple) -> tuple:
        aim = max(number[0] - last[1], number[1])
        rounded = shortest(aim, error)
        return rounded, rounded - aim

    written = accumulate(numbers, step, initial=(box[0], box[0] - run[2]))
    next(written)
    return [*run[:2], *box, *([next(written)[0], next(written)[0]] if isinstance(w, list) else next(written)[0] for w in run[6:])]


def _plain(value):
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, float):
        return None if not math.isfinite(value) else int(value) if value.is_integer() and abs(value) < 1e21 else value
    return value


def dump_runs(runs: list | None) -> str | None:
    """Runs as a text map: compacted, with whole numbers without a decimal point."""
    return None if not isinstance(runs, list) else json.dumps([_plain(compact(r)) for r in runs], separators=(",", ":"))


def run_errors(original, compacted) -> dict:
    """How far compaction moves a run's characters: greatest and mean, at their beginnings and ends."""
    a, b = positions(original), positions(compacted)
    if len(a) != len(b):
        raise ValueError("the runs differ in length")
    first = [abs(x[0] - y[0]) for x, y in zip(a, b)]
    last = [abs(x[1] - y[1]) for x, y in zip(a, b)]
    n = len(a)
    return {
        "characters": n, "max_first": max(first, default=0), "max_last": max(last, default=0), "max": max([*first, *last], default=0),
        "mean_first": sum(first) / n if n else 0, "mean_last": sum(last) / n if n else 0,
    }


def error_report(original, compacted, error: float | None = None) -> str:
    told = run_errors(original, compacted)
    verdict = "" if error is None else f", {'within' if told['max'] <= error + 1e-9 else 'beyond'} {error}"
    return f"{told['characters']} characters, greatest error {told['max']:.4f}{verdict}, mean {told['mean_first']:.4f} and {told['mean_last']:.4f}"


def slice_runs(runs: list, text_units: list[str], start: int, end: int) -> list:
    """The runs of the units [start, end) of a text.  A run keeps its whole box, and its soft hyphen if it is cut at its end."""
    glyphs = [0]
    for u in text_units:
        glyphs.append(glyphs[-1] + (u not in " \n\t"))
    low, high = glyphs[start], glyphs[end]
    out, at = [], 0
    for run in runs:
        if not isinstance(run, list) or len(run) < 6:
            continue
        spans = positions(run)
        soft = bool(run[0] & SOFT_HYPHEN)
        shown = spans[:-1] if soft else spans
        first, last = max(0, low - at), min(len(shown), high - at)
        at += len(shown)
        if first >= last:
            continue
        keep = soft and last == len(shown)
        piece = [run[0] if keep or not soft else run[0] & ~SOFT_HYPHEN, *run[1:6]]
        edge = run[3] if vertical(axis(run[0])) else run[2]
        for a, b in [*shown[first:last], *(spans[-1:] if keep else [])]:
            if _number(a) and _number(b):
                piece.append([a - edge, b - a] if abs(a - edge) > EPS else b - a)
                edge = b
        out.append(piece)
    return out


# ---- from characters on a page to text nodes

_FLAGS = ("bold", "italic", "sub", "sup", "monospace")


def _style(char: dict) -> dict:
    style = {f: True for f in _FLAGS if char.get(f)}
    if char.get("sup"):
        style["_fontSize"] = char.get("fontSize")
    return style


def _looks(char: dict) -> tuple:
    return tuple(bool(char.get(f)) for f in _FLAGS)


def _units(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


def _settle_marks(chars: list[dict]) -> list[dict]:
    """A blank with a combining mark, drawn over the next character, becomes a mark behind that character."""
    out, skip = [], False
    for k, char in enumerate(chars):
        if skip:
            skip = False
            continue
        if len(char["c"]) < 2 or char["c"][0] != " ":
            out.append(char)
            continue
        mark = {**char, "c": char["c"][1:]}
        if k + 1 < len(chars):
            base = chars[k + 1]
            for flag in ("spaceAfter", "lineBreakAfter"):
                mark[flag] = bool(base.get(flag)) or bool(char.get(flag))
            out.append({**base, "spaceAfter": False, "lineBreakAfter": False})
            skip = True
        out.append(mark)
    return out


class _Run:
    """Glyphs of one line and direction, in the making."""

    def __init__(self, char: dict):
        self.axis, self.rtl, self.line = char.get("axisDir") or 0, bool(char.get("rtl")), char.get("rect")
        self.box: list | None = None
        self.widths: list = []
        self.end: float | None = None
        self.space = 0.0
        self.soft = False

    def takes(self, char: dict) -> bool:
        rect = char.get("rect")
        if self.axis != (char.get("axisDir") or 0) or self.rtl != bool(char.get("rtl")) or not self.line or not rect:
            return False
        a, b = (0, 2) if vertical(self.axis) else (1, 3)
        return abs(self.line[a] - rect[a]) <= EPS and abs(self.line[b] - rect[b]) <= EPS

    def add(self, char: dict, units: int, space: bool) -> None:
        rect = char.get("rect")
        a, b = (1, 3) if vertical(self.axis) else (0, 2)
        gap = self.space
        if self.widths and rect:
            gap += rect[a] - (self.end or 0)
        extent = rect[b] - rect[a] if rect else 0
        width = extent * 2 / 3 if space and extent > 0 else extent
        self.widths.append([gap, width] if abs(gap) > EPS else width)
        self.widths += [0] * (units - 1)
        self.end, self.space = (rect[b] if rect else None), extent - width
        if rect:
            low, high = (self.box or rect)[:2], (self.box or rect)[2:4]
            self.box = [min(low[0], rect[0]), min(low[1], rect[1]), max(high[0], rect[2]), max(high[1], rect[3])]

    def done(self, page: int) -> list | None:
        if not self.widths or self.box is None:
            return None
        header = (self.axis & 3) << AXIS_SHIFT | (SOFT_HYPHEN if self.soft else 0) | (RIGHT_TO_LEFT if self.rtl else 0)
        lone = len(self.widths) == 1 and not isinstance(self.widths[0], list)
        return [header, page, *self.box, *([] if lone else self.widths)]


def _dash(text: str) -> bool:
    return bool(text) and all(unicodedata.category(c) == "Pd" for c in text)


def text_nodes(page: int, chars: list[dict]) -> list[dict]:
    """Text nodes of a page's characters, split where the style changes, with their glyph runs.

    A line break gives a blank, but not behind a dash, unless a blank stands before the dash.  A soft
    hyphen at a line break is layout only.  Blanks at a node's ends become nodes of their own.
    """
    chars = _settle_marks(chars or [])
    nodes: list[dict] = []
    groups: list[tuple[dict, list[tuple[int, dict]]]] = []
    for k, char in enumerate(chars):
        if not groups or _looks(groups[-1][0]) != _looks(char):
            groups.append((char, []))
        groups[-1][1].append((k, char))
    for lead, members in groups:
        text, runs, run = "", [], None
        for k, char in members:
            last = k == len(chars) - 1
            breaks = bool(char.get("lineBreakAfter")) and not last
            hyphen = breaks and bool(char.get("ignorable") or char.get("softHyphen"))
            if run is None or not hyphen and not run.takes(char):
                if run is not None:
                    runs.append(run)
                run = _Run(char)
            if hyphen:
                run.add(char, 1, False)
                run.soft = True
                continue
            space = bool(char.get("spaceAfter"))
            spaced_dash = _dash(char["c"]) and k > 0 and bool(chars[k - 1].get("spaceAfter"))
            text += char["c"] + (" " if space else "") + (" " if breaks and (not _dash(char["c"]) or spaced_dash) else "")
            run.add(char, _units(char["c"]), space)
            run.soft = False
        if run is not None:
            runs.append(run)
        made = [r for r in (x.done(page) for x in runs) if r]
        core = text.strip(" ")
        lead_blanks = len(text) - len(text.lstrip(" "))
        nodes += [{"text": " "}] * lead_blanks
        if core:
            node = {"text": core}
            if _style(lead):
                node["style"] = _style(lead)
            if made:
                node["anchor"] = {"textMap": dump_runs(made)}
            nodes.append(node)
        nodes += [{"text": " "}] * (len(text) - lead_blanks - len(core))
    return nodes


def _ink(char: dict) -> bool:
    return bool(char.get("rect")) and bool(char.get("c")) and bool(char["c"].strip())


def column_width(chars: list[dict]) -> float:
    """The width of a monospaced character: the commonest, else the mean of all, else 1."""
    counts: dict[float, int] = {}
    for char in chars:
        if char.get("monospace") and _ink(char):
            width = half_up(char["rect"][2] - char["rect"][0], 2)
            if width > 0:
                counts[width] = counts.get(width, 0) + 1
    if counts:
        return max(counts, key=counts.get)
    widths = [w for c in chars if _ink(c) and (w := c["rect"][2] - c["rect"][0]) > 0]
    return sum(widths) / len(widths) if widths else 1


def preformatted_nodes(chars: list[dict]) -> list[dict]:
    """Text nodes of preformatted characters: blanks made from indents and gaps, newlines between lines, no glyph runs."""
    if not chars:
        return []
    width = column_width(chars)
    lines: list[list[dict]] = [[]]
    for k, char in enumerate(chars):
        lines[-1].append(char)
        if char.get("lineBreakAfter") and k < len(chars) - 1:
            lines.append([])
    starts = [next((c["rect"][0] for c in line if _ink(c)), None) for line in lines]
    zero = min((s for s in starts if s is not None), default=0)
    nodes: list[dict] = []
    looks, style, text = None, {}, ""

    def close() -> None:
        nonlocal text
        if text:
            nodes.append({"text": text, **({"style": style} if style else {})})
        text = ""

    for number, (line, start) in enumerate(zip(lines, starts)):
        if start is not None:
            text += " " * max(0, math.floor((start - zero) / width + 0.5))
        end = None
        for char in line:
            if (char.get("ignorable") or char.get("softHyphen")) and char.get("lineBreakAfter"):
                continue
            if looks is None or looks != _looks(char):
                close()
                looks, style = _looks(char), {k: v for k, v in _style(char).items() if k != "monospace"}
            if end is not None and char.get("rect"):
                gap = char["rect"][0] - end
                if gap > width * 0.5:
                    text += " " * max(0, math.floor(gap / width + 0.5))
            text += char["c"]
            if char.get("rect"):
                end = char["rect"][2]
        if number < len(lines) - 1:
            text += "\n"
    close()
    return nodes


# ---- the same on runs as Spark structs <header, page_index, min_x, min_y, max_x, max_y, widths: array<struct<delta, width>>>


def is_vertical_col(header: Column) -> Column:
    return F.shiftright(header, AXIS_SHIFT).bitwiseAND(F.lit(3)).isin(1, 3)


def positions_col(run: Column) -> Column:
    """ARRAY<STRUCT<x1, x2>> of a run's characters along its axis."""
    upright = is_vertical_col(run.header)
    start, end = F.when(upright, run.min_y).otherwise(run.min_x), F.when(upright, run.max_y).otherwise(run.max_x)
    empty = F.struct(start.alias("at"), F.array().cast("array<struct<x1:double,x2:double>>").alias("out"))
    walked = F.aggregate(
        run.widths,
        empty,
        lambda s, w: F.struct(
            (s.at + F.coalesce(w.delta, F.lit(0.0)) + w.width).alias("at"),
            F.array_append(s.out, F.struct((s.at + F.coalesce(w.delta, F.lit(0.0))).alias("x1"), (s.at + F.coalesce(w.delta, F.lit(0.0)) + w.width).alias("x2"))).alias("out"),
        ),
        lambda s: s.out,
    )
    return F.when(F.size(run.widths) == 0, F.array(F.struct(start.alias("x1"), end.alias("x2")))).otherwise(walked)


def shortest_col(value: Column, error: float = MAX_ERROR) -> Column:
    """The decimal of fewest digits (0 to 6) within the error, halves rounded up."""
    tries = []
    for digits in range(7):
        f = float(10**digits)
        rounded = F.floor(value * f + 0.5) / f
        tries.append(F.when(F.abs(rounded - value) <= error + 1e-9, rounded))
    return F.coalesce(*tries, value)
