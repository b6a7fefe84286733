"""From rectangles on pages to blocks, from blocks to sentences, and from sentences back to rectangles."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import glyphs
from ..functions.sentences import sentence_spans
from ..functions.utf16 import BLANKS_TEXT, py_len, u16_len, u16_slice
from .ranges import leaves_in_ranges, split_points

_RECT = T.ArrayType(T.DoubleType())


def _finite(column):
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))


def blocks_at_rects(nodes: DataFrame, pages: DataFrame, rects: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, request_id, range_start, range_end): the leaf blocks with a rectangle that meets one of the request's.

    ``rects`` has key, request_id and page_rect ([page, x1, y1, x2, y2]); touching counts as meeting.  The
    page's range must cover the block too.  Every block comes out once per request.
    """
    asked = rects.where((F.size("page_rect") >= 5) & _finite(F.get("page_rect", F.lit(0)))).select(
        key, "request_id", F.get("page_rect", F.lit(0)).cast("int").alias("page_index"), F.slice("page_rect", 2, 4).alias("q")
    )
    drawn = nodes.where("kind = 'block' AND is_leaf AND page_rects IS NOT NULL").select(key, "ref", "ref_end", F.explode("page_rects").alias("r")).where(F.size("r") >= 5)
    drawn = drawn.select(key, "ref", "ref_end", F.get("r", F.lit(0)).cast("int").alias("page_index"), F.slice("r", 2, 4).alias("b"))
    at = lambda c, i: F.get(c, F.lit(i))
    meets = ~((at("q", 0) > at("b", 2)) | (at("q", 2) < at("b", 0)) | (at("q", 1) > at("b", 3)) | (at("q", 3) < at("b", 1)))
    hit = drawn.join(asked, [key, "page_index"]).where(meets).select(key, "request_id", "page_index", "ref", "ref_end").distinct()
    ranges = pages.join(hit.select(key, "page_index").distinct(), [key, "page_index"], "left_semi").select(key, "page_index", "range_start", "range_end")
    covered = leaves_in_ranges(nodes, ranges, key).select(key, "page_index", "ref")
    kept = hit.join(covered, [key, "page_index", "ref"], "left_semi")
    return kept.select(key, "request_id", F.col("ref").alias("range_start"), F.col("ref_end").alias("range_end")).distinct()


def merge_intervals(df: DataFrame, by: list[str], start: str = "start", end: str = "end", bucket: int = 1 << 16) -> DataFrame:
    """(by, start, end): the union of each group's intervals; touching ones become one.  Rows with a NULL end or start have no interval.

    Intervals are put in order within buckets of starts; between buckets one row of each is carried, so a
    group that holds a third of all intervals is no task's burden.  ``bucket`` is their width.
    """
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_bucket", F.floor(F.col(start) / bucket))
    inside, across = Window.partitionBy(*by, "_bucket").orderBy(start, end), Window.partitionBy(*by).orderBy("_bucket")
    before = lambda order: order.rowsBetween(Window.unboundedPreceding, -1)
    # how far the intervals before reach; an interval beyond that opens an island
    reach = rows.groupBy(*by, "_bucket").agg(F.max(end).alias("_end")).select(*by, "_bucket", F.max("_end").over(before(across)).alias("_reached"))
    reached = F.greatest(F.max(end).over(before(inside)), F.col("_reached"))
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_bucket")]

    def beside(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        on = keys[0]
        for k in keys[1:]:
            on = on & k
        return left.alias("a").join(right.alias("b"), on).select("a.*", f"b.{name}")

    told = beside(rows, reach, "_reached").withColumn("_opens", F.when(F.coalesce(F.col(start) > reached, reached.isNull()), F.col(start)))
    opened = told.groupBy(*by, "_bucket").agg(F.max("_opens").alias("_last")).select(*by, "_bucket", F.last("_last", ignorenulls=True).over(before(across)).alias("_carried"))
    local = told.withColumn("_local", F.last("_opens", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return beside(local, opened, "_carried").groupBy(*by, F.coalesce("_local", "_carried").alias("_island")).agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


_SENTENCE = T.ArrayType(T.StructType().add("sid", T.IntegerType()).add("text", T.StringType()))


def _trim(text: str) -> str:
    return text.strip(BLANKS_TEXT)


@F.pandas_udf(_SENTENCE)
def sentences_col(text: pd.Series) -> pd.Series:
    """The sentences of a text, trimmed and numbered; none if it is blank."""
    return text.map(lambda t: [] if t is None or not _trim(t) else [{"sid": k, "text": _trim(t[a:b])} for k, (a, b) in enumerate(sentence_spans(t))])


def selected_texts(nodes: DataFrame, selection: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """(key, ref, type, text) of the leaf blocks that a selection (key, range_start, range_end) covers, cut to it.

    A document without any selected range is selected as a whole.  Leaves under or at an excluded node are
    left out.  Overlapping ranges count once.
    """
    excluded = nodes.where("kind = 'block' AND flow_class = 'excluded'").select(key, F.col("ref").alias("_ancestor"))
    leaves = nodes.where("kind = 'block' AND is_leaf").select(key, "ref", "type", "top_index")
    above = leaves.withColumn("_ancestor", F.explode(F.transform(F.sequence(F.lit(1), F.size("ref")), lambda n: F.slice(F.col("ref"), F.lit(1), n))))
    gone = above.join(excluded, [key, "_ancestor"], "left_semi").select(key, "ref").distinct()
    leaves = leaves.join(gone, [key, "ref"], "left_anti")
    texts = nodes.where("kind = 'text'").select(key, F.col("parent_ref").alias("ref"), F.col("ref").alias("seg"), F.col("text").alias("seg_text"))
    if selection is None:
        chosen = leaves.join(texts, [key, "ref"], "left").withColumn("piece", F.coalesce("seg_text", F.lit(""))).withColumn("start", F.lit(0))
    else:
        ranged = selection.select(key).distinct().withColumn("_ranged", F.lit(True))
        bounded = split_points(selection.select(key, "range_start", "range_end"), nodes, key, "range_start").withColumnsRenamed({"point_ref": "start_ref", "point_offset": "start_offset"})
        bounded = split_points(bounded, nodes, key, "range_end").withColumnsRenamed({"point_ref": "end_ref", "point_offset": "end_offset"})
        hit = leaves_in_ranges(nodes, bounded, key).join(leaves.select(key, "ref", "type"), [key, "ref"])
        seg = F.col("seg")
        length = u16_len(F.col("seg_text"))
        low = F.when(seg == F.col("start_ref"), F.coalesce("start_offset", F.lit(0))).otherwise(0)
        high = F.when(seg == F.col("end_ref"), F.coalesce("end_offset", F.lit(0))).otherwise(length)
        spans = hit.join(texts, [key, "ref"]).where((seg >= F.col("start_ref")) & (seg <= F.col("end_ref")))
        spans = spans.select(key, "ref", "type", "seg", "seg_text", F.greatest(F.lit(0), F.least(low, length)).alias("start"), F.greatest(F.lit(0), F.least(high, length)).alias("end")).where("end > start")
        merged = merge_intervals(spans, [key, "ref", "type", "seg", "seg_text"])
        pieces = merged.withColumn("piece", u16_slice(F.col("seg_text"), F.col("start"), F.col("end"))).select(key, "ref", "type", "seg", "start", "piece")
        empty = hit.select(key, "ref", "type").distinct().select(key, "ref", "type", F.lit(None).cast("array<int>").alias("seg"), F.lit(0).alias("start"), F.lit("").alias("piece"))
        unranged = leaves.join(ranged, key, "left_anti").join(texts, [key, "ref"], "left").select(key, "ref", "type", "seg", F.lit(0).alias("start"), F.coalesce("seg_text", F.lit("")).alias("piece"))
        chosen = pieces.unionByName(empty).unionByName(unranged)
    gathered = chosen.groupBy(key, "ref", "type").agg(F.array_sort(F.collect_list(F.struct("seg", "start", "piece"))).alias("p"))
    return gathered.select(key, "ref", F.coalesce("type", F.lit("block")).alias("type"), F.array_join(F.transform("p", lambda x: x.piece), "").alias("text"))


def content_sentences(nodes: DataFrame, selection: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, ref, type, sid, text): the sentences of the selected leaves; a blank leaf has one row with a NULL sid."""
    told = selected_texts(nodes, selection, key).withColumn("s", sentences_col("text"))
    return told.select(key, "ref", "type", F.explode_outer("s").alias("s")).select(key, "ref", "type", "s.sid", "s.text")


def content_trees(nodes: DataFrame, selection: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, content): the selected content of each document as nested JSON with sentences at the leaves."""
    leaves = selected_texts(nodes, selection, key).withColumn("s", sentences_col("text")).select(key, "ref", "type", "s")
    kinds = nodes.where("kind = 'block' AND NOT is_leaf").select(key, "ref", F.coalesce("type", F.lit("block")).alias("type"))
    containers = kinds.join(
        leaves.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.size("ref") - 1), lambda n: F.slice(F.col("ref"), F.lit(1), n))).alias("ref")).distinct(), [key, "ref"], "left_semi"
    )
    rows = leaves.select(key, "ref", "type", F.to_json("s").alias("s")).unionByName(containers.select(key, "ref", "type", F.lit(None).cast("string").alias("s")))

    def nest(key_value: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        roots: list = []
        made: dict = {}
        for ref, kind, s in sorted(zip(map(lambda r: tuple(int(x) for x in r), pdf["ref"]), pdf["type"], pdf["s"]), key=lambda x: x[0]):
            item = {"type": kind, "ref": ".".join(map(str, ref)), "content": json.loads(s) if isinstance(s, str) else []}
            made[ref] = item
            up = made.get(ref[:-1])
            (roots if up is None else up["content"]).append(item)
        return pd.DataFrame([(key_value[0], json.dumps(roots, ensure_ascii=False, separators=(",", ":")))], columns=[key, "content"])

    return rows.groupBy(key).applyInPandas(nest, T.StructType([nodes.schema[key], T.StructField("content", T.StringType())]))


# ---- sentence rectangles


def _valid(r) -> bool:
    return r is not None and len(r) >= 4 and all(isinstance(x, (int, float)) and math.isfinite(x) for x in r[:4])


def _distinct(rects: list[list[float]]) -> list[list[float]]:
    return [list(r) for r in dict.fromkeys(tuple(float(x) for x in r[:5]) for r in rects)]


def _line_boxes(boxes: list) -> list[list[float]]:
    """Boxes of characters joined along lines: same page, overlapping by 0.6 of the lower height, and near."""
    out: list[list[float]] = []
    current = None
    for box in boxes:
        if box is None or not _valid(box[0]):
            current = None
            continue
        (x1, y1, x2, y2), page = box[0][:4], box[1]
        if current is not None:
            low = max(0.001, min(current[4] - current[2], y2 - y1))
            overlap = min(current[4], y2) - max(current[2], y1)
            near = x1 - current[3] <= max(5, 2 * max(current[4] - current[2], y2 - y1))
            if current[0] == page and overlap / low >= 0.6 and near:
                current[1:] = [min(current[1], x1), min(current[2], y1), max(current[3], x2), max(current[4], y2)]
                continue
        current = [page, x1, y1, x2, y2]
        out.append(current)
    return _distinct(out)


def sentence_rects(texts: list[tuple[str, str | None]], block_rects: list | None, sid: int) -> list[list[float]]:
    """[page, x1, y1, x2, y2] of a sentence of a block, given its text nodes (text, text map) and own rectangles."""
    own = _distinct([r for r in block_rects or [] if len(r) >= 5 and _valid(r[1:5]) and math.isfinite(r[0])])
    whole = "".join(t for t, _ in texts)
    if not whole:
        return own
    spans = sentence_spans(whole)
    if not 0 <= sid < len(spans):
        return []
    boxes: list = []
    for text, text_map in texts:
        units = [u for c in text for u in ([c] if c <= "￿" else [c, c])]
        runs = glyphs.parse_runs(text_map)
        shown = glyphs.boxes_of_text(units, runs) if glyphs.glyph_boxes(runs) else [None] * len(units)
        boxes += shown
    if any(b is not None and _valid(b[0]) for b in boxes):
        a, b = py_len(whole[: spans[sid][0]]), py_len(whole[: spans[sid][1]])
        return _line_boxes(boxes[a:b])
    if not own or len(spans) == 1:
        return own
    first = min(len(own) - 1, sid * len(own) // len(spans))
    return own[first : max(first + 1, min(len(own), (sid + 1) * len(own) // len(spans)))]


def parse_sid(value: str | int | None) -> int | None:
    """A sentence number: a number, or the digits behind the last 's' of an id."""
    if isinstance(value, int) and not isinstance(value, bool):
        return value if value >= 0 else None
    m = isinstance(value, str) and (re.search(r"[sS](\d+)$", value) or re.fullmatch(r"(\d+)", value))
    return int(m[1]) if m else None


def sentence_page_rects(nodes: DataFrame, requests: DataFrame, key: str = "doc_id") -> DataFrame:
    """(columns of requests, page_rects) of every request (key, ref, sid); sid is a number or an id that ends in one."""
    texts = nodes.where("kind = 'text'").groupBy(key, F.col("parent_ref").alias("ref")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "text", "text_map"))).alias("_texts"))
    blocks = nodes.where("kind = 'block'").select(key, "ref", F.col("page_rects").alias("_own"), F.lit(True).alias("_known"))

    @F.pandas_udf(T.ArrayType(_RECT))
    def rects(texts: pd.Series, own: pd.Series, sid: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for t, o, s, k in zip(texts, own, sid, known):
            number = parse_sid(s)
            nodes_of = [] if t is None else [(x["text"], x["text_map"]) for x in t]
            own_rects = [] if o is None else [[float(v) for v in r] for r in o]
            out.append([] if number is None or k is not True and not k else sentence_rects(nodes_of, own_rects, number))
        return pd.Series(out)

    told = requests.join(blocks, [key, "ref"], "left").join(texts, [key, "ref"], "left")
    return told.withColumn("page_rects", rects("_texts", "_own", F.col("sid").cast("string"), F.coalesce("_known", F.lit(False)))).drop("_texts", "_own", "_known")


