"""Editing a stretch of a block's text: nodes are split at its ends, and page boundaries stay where they were in the text."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import glyphs
from ..functions.utf16 import py_len, py_slice
from ..sources.trees import is_text


def _node_at(tree: dict, ref: list[int]):
    node = {"content": tree.get("content")}
    for k in ref:
        inner = node.get("content") if isinstance(node, dict) else None
        if not isinstance(inner, list) or not 0 <= k < len(inner) or not isinstance(inner[k], dict):
            return None
        node = inner[k]
    return node


def _segments(node, ref: tuple) -> list[tuple[tuple, int, int]]:
    """(ref, start, end) of the text nodes under a node, in units of its text."""
    out, at, stack = [], 0, [(node, ref)]
    while stack:
        n, r = stack.pop()
        if is_text(n):
            end = at + py_len(n["text"])
            out.append((r, at, end))
            at = end
        elif isinstance(n, dict) and isinstance(n.get("content"), list):
            stack += [(c, (*r, k)) for k, c in reversed(list(enumerate(n["content"])))]
    return out


def _piece(node: dict, start: int, end: int) -> dict:
    out = {**node, "text": py_slice(node["text"], start, end)}
    anchor = node.get("anchor")
    if isinstance(anchor, dict) and anchor.get("textMap"):
        units = [u for c in node["text"] for u in ([c] if c <= "￿" else [c, c])]
        runs = glyphs.slice_runs(glyphs.parse_runs(anchor["textMap"]), units, start, end)
        if runs:
            out["anchor"] = {**anchor, "textMap": glyphs.dump_runs(runs)}
        else:
            out.pop("anchor")
    return out


def _boundaries(tree: dict, block, ref: tuple) -> list[tuple[list, int, int, bool]]:
    """(range, side, offset in the block's text, whether it had a text offset) of the page boundaries inside a block."""
    catalog = tree.get("catalog") if isinstance(tree.get("catalog"), dict) else {}
    segments = _segments(block, ref)
    places = {r: (a, b) for r, a, b in segments}
    out = []
    for page in catalog.get("pages") or []:
        bounds = page.get("contentRange") if isinstance(page, dict) else None
        for side, point in enumerate(bounds[:2] if isinstance(bounds, list) else []):
            if not isinstance(point, list) or not all(isinstance(x, int) for x in point):
                continue
            at = tuple(point)
            offset = None
            if at[:-1] in places:
                at, offset = at[:-1], at[-1]
            if at == ref or at[: len(ref)] != ref:
                continue
            if at in places:
                a, b = places[at]
                absolute = a if offset is None else a + max(0, min(offset, b - a))
            else:
                later = [a for r, a, _ in segments if r[: len(at)] == at or r >= at]
                absolute = later[0] if later else segments[-1][2] if segments else 0
            out.append((bounds, side, absolute, offset is not None))
    return out


def _restore(block, ref: tuple, boundaries) -> None:
    segments = _segments(block, ref)
    for bounds, side, absolute, had_offset in boundaries:
        if not segments:
            bounds[side] = list(ref)
            continue
        place = max(0, min(absolute, segments[-1][2]))
        starts = [r for r, a, _ in segments if a == place]
        if starts and not had_offset:
            bounds[side] = list(starts[0])
            continue
        r, a, _ = next(s for s in segments if s[1] <= place <= s[2])
        bounds[side] = [*r, place - a]


def _cut(node: dict, stops: list[int]) -> list[dict]:
    """A text node as the pieces between stops (ascending, from 0 to its length)."""
    if len(stops) == 2:
        return [node]
    return [_piece(node, a, b) for a, b in zip(stops, stops[1:])]


def apply_to_text(tree: dict, block_ref: list[int], start: int, end: int, change: Callable[[dict], dict | None]) -> list[int] | None:
    """Changes the nodes of a block's text units [start, end] (inclusive, either order) in place.

    ``change`` gets each covered node, cut to the stretch, and returns what replaces it; nothing drops it.
    Returns the ref of the first covered node, None if there is none.  The ref may also name a text node:
    covered whole, it takes on what replaces it (nothing leaves it as it is); covered in part, it gets its
    pieces as content; untouched, it stays as it is.
    """
    block = _node_at(tree, block_ref)
    if block is None or not isinstance(start, int) or not isinstance(end, int):
        return None
    start, end = min(start, end), max(start, end)
    ref = tuple(block_ref)
    boundaries = _boundaries(tree, block, ref)
    touched: list[tuple] = []
    split = False

    def pieces_of(node: dict, here: tuple, at: int) -> list[dict]:
        nonlocal split
        n = py_len(node["text"])
        covered = (max(0, start - at), min(n, end + 1 - at))
        if at + n - 1 < start or at > end:
            return [node]
        pieces = _cut(node, sorted({0, *covered, n}) if n else [0, 0])
        split = split or len(pieces) > 1
        inside = 1 if covered[0] > 0 else 0
        touched.append((*here[:-1], here[-1] + inside))
        pieces[inside : inside + 1] = [r for r in [change(pieces[inside])] if r]
        return pieces

    if is_text(block):
        result = pieces_of(block, ref, 0)
        if split:
            block["content"] = result
            _restore(block, ref, boundaries)
        elif touched and result:
            block.update(result[0])
        return list(touched[0]) if touched else None

    at = 0

    def walk(node: dict, here: tuple) -> None:
        nonlocal at
        inner: list = []
        for child in node["content"]:
            place = (*here, len(inner))
            if is_text(child):
                inner += pieces_of(child, place, at)
                at += py_len(child["text"])
            else:
                if isinstance(child, dict) and isinstance(child.get("content"), list):
                    walk(child, place)
                inner.append(child)
        node["content"] = inner

    if isinstance(block.get("content"), list):
        walk(block, ref)
    if split:
        _restore(block, ref, boundaries)
    return list(touched[0]) if touched else None


def edit_trees(trees: DataFrame, requests: DataFrame, change: Callable[[dict, dict], dict | None], key: str = "doc_id", column: str = "tree") -> DataFrame:
    """(key, tree, refs): the documents after all their edits, in the order of ``edit_no``.

    ``requests`` has key, edit_no, block_ref, offset_start, offset_end and ``argument`` (any string);
    ``change(node, request)`` gives what replaces a covered node.  A document's edits are gathered beside
    it, so the trees are shuffled once; documents without edits come out as they are.
    """
    edits = requests.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("edit_no", "block_ref", "offset_start", "offset_end", "argument"))).alias("_edits"))
    out_type = T.StructType().add(column, T.StringType()).add("refs", T.ArrayType(T.ArrayType(T.IntegerType())))

    @F.pandas_udf(out_type)
    def run(texts: pd.Series, edits: pd.Series) -> pd.DataFrame:
        rows = []
        for text, asked in zip(texts, edits):
            if asked is None or text is None:
                rows.append((text, None))
                continue
            tree = json.loads(text)
            refs = []
            for e in asked:
                ref = None if e["block_ref"] is None else [int(x) for x in e["block_ref"]]
                done = None if ref is None else apply_to_text(tree, ref, e["offset_start"], e["offset_end"], lambda node, e=e: change(node, e))
                refs.append(done)
            told = json.dumps(tree, ensure_ascii=False, separators=(",", ":"))
            # a cut inside a surrogate pair leaves halves, which no table can hold: U+FFFD, of one unit too, stands for each
            rows.append((told.encode("utf-16", "surrogatepass").decode("utf-16", "replace"), refs))
        return pd.DataFrame(rows, columns=out_type.names)

    told = trees.select(key, column).join(edits, key, "left").withColumn("_out", run(column, "_edits"))
    return told.select(key, F.col(f"_out.{column}").alias(column), "_out.refs")
