"""Glyph runs as tables: decoded, per character, checked against their compaction, and made from characters."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import glyphs
from .text import text_positions

_BOX = (
    T.StructType()
    .add("unit", T.IntegerType())
    .add("char", T.StringType())
    .add("page_index", T.IntegerType())
    .add("x1", T.DoubleType())
    .add("y1", T.DoubleType())
    .add("x2", T.DoubleType())
    .add("y2", T.DoubleType())
)

_RUN = (
    T.StructType()
    .add("run_no", T.IntegerType())
    .add("header", T.IntegerType())
    .add("page_index", T.IntegerType())
    .add("min_x", T.DoubleType())
    .add("min_y", T.DoubleType())
    .add("max_x", T.DoubleType())
    .add("max_y", T.DoubleType())
    .add("widths", T.ArrayType(T.StructType().add("delta", T.DoubleType()).add("width", T.DoubleType())))
)


def glyph_runs(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ref, run_no, header, page_index, min_x, min_y, max_x, max_y, widths) of every run of every text node; malformed runs are left out."""

    @F.pandas_udf(T.ArrayType(_RUN))
    def decode(maps: pd.Series) -> pd.Series:
        def one(text):
            rows = []
            for k, run in enumerate(glyphs.parse_runs(text)):
                if not isinstance(run, list) or len(run) < 6 or not all(isinstance(x, (int, float)) for x in run[:6]):
                    continue
                widths = [{"delta": float(w[0]), "width": float(w[1])} if isinstance(w, list) else {"delta": None, "width": float(w)} for w in run[6:]]
                rows.append(dict(zip(_RUN.names, [k, int(run[0]), int(run[1]), *map(float, run[2:6]), widths])))
            return rows

        return maps.map(one)

    told = nodes.where("kind = 'text' AND text_map IS NOT NULL").select(key, "ref", decode("text_map").alias("runs"))
    return told.select(key, "ref", F.explode("runs").alias("r")).select(key, "ref", "r.*")


def block_units(nodes: DataFrame, key: str = "doc_id", level: int = 1) -> DataFrame:
    """Every UTF-16 unit of blocks' texts with its look and place.

    (key, root_ref, offset, char, style, target, refs, back_refs, page_index, x1, y1, x2, y2): the offset is
    the unit's in the text of the block at ``level``.  Blanks, and units without a glyph, have no place.  An
    astral character has one row at its first unit and its second unit one with an empty ``char``.
    """

    @F.pandas_udf(T.ArrayType(_BOX))
    def place(texts: pd.Series, maps: pd.Series) -> pd.Series:
        def one(text, text_map):
            units = [u for c in text for u in ([c] if c <= "￿" else [c, ""])]
            shown = glyphs.boxes_of_text([u or "x" for u in units], glyphs.parse_runs(text_map)) if text_map is not None else [None] * len(units)
            rows = []
            for k, (u, box) in enumerate(zip(units, shown)):
                rect, page = ([float(v) for v in box[0]], int(box[1])) if box else ([None] * 4, None)
                rows.append(dict(zip(_BOX.names, [k, u, page, *rect])))
            return rows

        return pd.Series([one(t, m) for t, m in zip(texts, maps)])

    placed = text_positions(nodes, key, level=level).where("text <> ''")
    looks = [c for c in ("style", "target", "refs", "back_refs") if c in nodes.columns]
    spread = placed.select(key, "root_ref", "start", *looks, F.explode(place("text", "text_map")).alias("u"))
    return spread.select(key, "root_ref", (F.col("start") + F.col("u.unit")).cast("int").alias("offset"), "u.char", *looks, "u.page_index", "u.x1", "u.y1", "u.x2", "u.y2")


def compaction_errors(nodes: DataFrame, key: str = "doc_id", error: float = glyphs.MAX_ERROR) -> DataFrame:
    """(key, runs, characters, max_error, mean_error): how far compaction moves the characters of a document's runs."""
    schema = T.StructType().add("characters", T.LongType()).add("max_error", T.DoubleType()).add("sum_error", T.DoubleType())

    @F.pandas_udf(T.ArrayType(schema))
    def compare(maps: pd.Series) -> pd.Series:
        def one(text):
            rows = []
            for run in glyphs.parse_runs(text):
                if isinstance(run, list) and len(run) >= 6:
                    told = glyphs.run_errors(run, glyphs.compact(run, error))
                    rows.append({"characters": told["characters"], "max_error": float(told["max"]), "sum_error": told["characters"] * (told["mean_first"] + told["mean_last"]) / 2})
            return rows

        return maps.map(one)

    told = nodes.where("kind = 'text' AND text_map IS NOT NULL").select(key, F.explode(compare("text_map")).alias("e"))
    return told.groupBy(key).agg(
        F.count("*").alias("runs"), F.sum("e.characters").alias("characters"), F.max("e.max_error").alias("max_error"),
        F.try_divide(F.sum("e.sum_error"), F.sum("e.characters")).alias("mean_error"),
    )


#: A character on a page, in the order of ``char_no`` within its block.
CHARACTERS = "doc_id string, page_index int, block_no int, char_no int, c string, rect array<double>, axis_dir int, rtl boolean, bold boolean, italic boolean, sub boolean, sup boolean, monospace boolean, font_size double, space_after boolean, line_break_after boolean, ignorable boolean, soft_hyphen boolean"

_FIELDS = {
    "c": "c", "rect": "rect", "axis_dir": "axisDir", "rtl": "rtl", "bold": "bold", "italic": "italic", "sub": "sub", "sup": "sup", "monospace": "monospace",
    "font_size": "fontSize", "space_after": "spaceAfter", "line_break_after": "lineBreakAfter", "ignorable": "ignorable", "soft_hyphen": "softHyphen",
}


def encode_characters(characters: DataFrame, preformatted: bool = False, key: str = "doc_id") -> DataFrame:
    """(key, page_index, block_no, ordinal, text, style, text_map): the text nodes of every block's characters.

    ``characters`` has the columns of CHARACTERS.  The state of the encoder runs along a block's characters,
    so each block is one group; rows with a NULL character are left out.
    """
    out = T.StructType([characters.schema[key], characters.schema["page_index"], characters.schema["block_no"]])
    out = out.add("ordinal", T.IntegerType()).add("text", T.StringType()).add("style", T.StringType()).add("text_map", T.StringType())

    names = [n for n in _FIELDS if n in characters.columns]

    def encode(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                chars = []
                for row in r["chars"]:
                    char = {_FIELDS[n]: row[n] for n in names if n == "rect" or row[n] is not None}
                    if char.get("c"):
                        chars.append(char)
                nodes = glyphs.preformatted_nodes(chars) if preformatted else glyphs.text_nodes(r["page_index"], chars)
                for k, n in enumerate(nodes):
                    rows.append((r[key], r["page_index"], r["block_no"], k, n["text"], json.dumps(n["style"]) if n.get("style") else None, (n.get("anchor") or {}).get("textMap")))
            columns = zip(*rows) if rows else [()] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow)], names=out.names)

    arrow = to_arrow_schema(out)
    gathered = characters.where("c IS NOT NULL").groupBy(key, "page_index", "block_no").agg(F.array_sort(F.collect_list(F.struct("char_no", *names))).alias("chars"))
    return gathered.mapInArrow(encode, out)
