"""Problem 1: cutting oversized texts into overlapping pieces at natural boundaries, by balanced targets.

The least number of pieces follows from length, limit and overlap.  Targets of equal length are laid out,
each is moved to the strongest boundary nearby, or else to the nearest one that keeps the limits; a run is
cut only where it has none.  If a piece then exceeds the limit, the layout is made again with one piece
more.  All lengths and positions are UTF-16 units.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.utf16 import u16_len

#: Boundaries by falling strength: a pattern's match ends where a cut may be made.
_BOUNDARIES = [
    (6, re.compile(r"\n\s*\n")),
    (5, re.compile(r"\n")),
    (4, re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？｡]+[」』）”’]*\s*|[؟۔।॥]+\s*")),
    (3, re.compile(r"[;:,–—]\s+|[；：，、､]\s*")),
    (2, re.compile(r"\s+")),
    (1, re.compile(r"[;,/|&=+]|(?<=\w)-(?=\w)")),
]
#: How far from its target a cut may be moved, as a share of the balanced piece length.
REACH = 0.25


def _cut_points(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions in characters, strengths), ascending; a position keeps its greatest strength."""
    best: dict[int, int] = {}
    for strength, pattern in _BOUNDARIES:
        for m in pattern.finditer(text):
            best.setdefault(m.end(), strength)
    best.pop(0, None)
    best.pop(len(text), None)
    at = sorted(best)
    return np.array(at, dtype=np.int64), np.array([best[p] for p in at], dtype=np.int64)


def _keeps_cluster(text: str, p: int) -> int:
    """The last position at or before p that parts no character from its marks, nor the parts of an emoji sequence."""
    q = p
    while q > 0 and q < len(text) and p - q < 32:
        c, before = text[q], text[q - 1]
        if unicodedata.combining(c) or c in "\u200d\ufe0e\ufe0f" or before == "\u200d" or "\U0001f3fb" <= c <= "\U0001f3ff":
            q -= 1
        elif "\u1160" <= c <= "\u11ff":
            q -= 1
        else:
            return q
    return p if q <= 0 or p - q >= 32 else q


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, piece) in UTF-16 units; the whole text as one piece if it is within the limit.

    Every piece but the first begins ``overlap`` units before the end of the one before it (one unit
    more where that would part a surrogate pair), and none exceeds ``limit``.  An overlap that leaves
    less than half of the limit for new text is lowered to that half.  A limit under 2 units counts as 2.
    """
    limit = max(int(limit), 2)
    overlap = max(0, min(int(overlap), limit // 2 - 1))
    wide = not text.isascii() and any(c > "\uffff" for c in text)
    if wide:
        sizes = np.fromiter((1 + (c > "\uffff") for c in text), dtype=np.int64, count=len(text))
        units = np.concatenate(([0], np.cumsum(sizes)))
    else:
        units = np.arange(len(text) + 1)
    total = int(units[-1])
    if total <= limit:
        return [(0, total, text)]
    at, strength = _cut_points(text)
    at_units = units[at]
    fresh = limit - overlap
    count = -(-(total - overlap) // fresh)

    def char_at(u: int) -> int:
        """The last character position at or before a unit."""
        return int(np.searchsorted(units, u, side="right")) - 1

    def legal(low_unit: int, cuts: list[int]) -> tuple[int, int]:
        """The least and the most unit for the next cut: the piece within its limit, the one after it beginning behind it."""
        # a unit for a surrogate pair included
        return max(int(units[cuts[-1]]) + 1 if cuts else 1, low_unit + overlap + (2 if overlap and wide else 1)), low_unit + limit

    while True:
        cuts: list[int] = []  # in characters
        low_unit = 0  # where the piece under construction starts
        if count > total:  # no balanced layout fits: fill each piece
            while total - low_unit > limit:
                least, most = legal(low_unit, cuts)
                lo, hi = bisect_left(at_units, least), bisect_right(at_units, most)
                cuts.append(int(at[hi - 1]) if lo < hi else char_at(most))
                low_unit = int(units[char_at(int(units[cuts[-1]]) - overlap)])
            break
        base, done = 0, 0  # targets are laid out from here, behind so many cuts
        whole = False  # the rest is one piece
        for k in range(1, count):
            step = (total - overlap - base) / (count - done)
            reach = max(1, int(step * REACH))
            target = base + int(round((k - done) * step)) + overlap
            least, most = legal(low_unit, cuts)
            lo, hi = bisect_left(at_units, max(target - reach, least)), bisect_right(at_units, min(target + reach, most))
            near = lo < hi
            if near:
                window, close = strength[lo:hi], -np.abs(at_units[lo:hi] - target)
                pick = int(at[lo + int(np.lexsort((close, window))[-1])])
            elif whole := total - low_unit <= limit:
                break
            elif (lo := bisect_left(at_units, least)) < (hi := bisect_right(at_units, most)):
                # nothing near the target: the nearest boundary that keeps the limits
                pick = int(at[lo + int(np.lexsort((strength[lo:hi], -np.abs(at_units[lo:hi] - target)))[-1])])
            else:
                # an unbroken run: no more cuts in it than it takes
                run_end = int(at_units[hi]) if hi < len(at_units) else total
                inside = -(-(run_end - low_unit - overlap) // fresh) - 1
                goal = min(max(target, least, run_end - inside * fresh), most)
                pick = _keeps_cluster(text, char_at(goal))
                if units[pick] < least:
                    pick = max(char_at(goal), int(np.searchsorted(units, least)))
            if units[pick] <= (int(units[cuts[-1]]) if cuts else 0) or units[pick] - low_unit > limit:
                break
            cuts.append(pick)
            low_unit = int(units[char_at(int(units[pick]) - overlap)])
            if not near:
                base, done = low_unit, k
        if (whole or len(cuts) == count - 1) and total - low_unit <= limit:
            break
        count += 1
    pieces, start = [], 0
    for c in [*cuts, len(text)]:
        pieces.append((int(units[start]), int(units[c]), text[start:c]))
        start = char_at(int(units[c]) - overlap) if c < len(text) else c
    return pieces


_PIECES = T.ArrayType(
    T.StructType()
    .add("piece_index", T.IntegerType())
    .add("piece_count", T.IntegerType())
    .add("start_unit", T.LongType())
    .add("end_unit", T.LongType())
    .add("text", T.StringType())
)


@F.pandas_udf(_PIECES)
def _split_udf(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
    def one(t, m, v):
        pieces = split_text(t, m, 0 if pd.isna(v) else v)
        return [
            {"piece_index": k, "piece_count": len(pieces), "start_unit": a, "end_unit": b, "text": p}
            for k, (a, b, p) in enumerate(pieces)
        ]

    return pd.Series([None if t is None else one(t, m, v) for t, m, v in zip(text, limit, overlap)])


def oversized(chunks: DataFrame, limits: DataFrame, kind: str = "processor_type", text: str = "text") -> DataFrame:
    """The rows whose text exceeds the limit of their kind, with ``_limit`` and ``_overlap``; repeated rows once.

    Kinds without a limit, NULL kinds, limits and texts are never oversized.  Several limits of a kind
    count as their least, with the least overlap.
    """
    bounds = (
        limits.where("max_units IS NOT NULL")
        .groupBy(F.col(kind).alias("_kind"))
        .agg(F.min("max_units").alias("_limit"), F.min("overlap_units").alias("_overlap"))
    )
    rows = chunks.where(F.col(text).isNotNull())
    return rows.join(bounds, rows[kind] == bounds["_kind"]).drop("_kind").where(u16_len(F.col(text)) > F.col("_limit"))


def split_oversized(chunks: DataFrame, limits: DataFrame, key: str = "chunk_id", kind: str = "processor_type", text: str = "text") -> DataFrame:
    """One row per piece of every oversized text: (key, piece_index, piece_count, start_unit, end_unit, text).

    Pieces are consecutive and within the limit, see :func:`split_text`.  Rows within their limit give
    no row.  Needs no shuffle but the removal of repeated rows.
    """
    big = oversized(chunks, limits, kind, text)
    big = big.groupBy(key).agg(F.min_by(F.struct(F.col(text).alias("t"), "_limit", "_overlap"), F.xxhash64(text)).alias("_row"))
    pieces = big.select(key, F.explode(_split_udf("_row.t", "_row._limit", "_row._overlap")).alias("_piece"))
    return pieces.select(key, "_piece.*")


def split_chunks(chunks: DataFrame, limits: DataFrame, blocks: DataFrame) -> DataFrame:
    """The pieces of oversized section chunks, with the range of top-level blocks that each covers.

    A chunk's text is its blocks' texts joined by newlines, without its heading, excluded and blank
    blocks, so the block at a position follows from running lengths.  Blocks are found by an equality
    join on (tree, block index), with the chunk's range spelled out: no tree is ever gathered in one
    task.  Where the lengths do not add up to the chunk's text (blocks missing or changed), the pieces
    get the chunk's own range, as they do for a chunk without blocks.
    """
    # of unlike rows of one id the same one that is cut
    range_ = F.struct("sdt_id", "start_block_index", "end_block_index", u16_len(F.col("text")).alias("units"))
    big = oversized(chunks, limits).groupBy("chunk_id").agg(F.min_by(range_, F.xxhash64("text")).alias("_row")).select("chunk_id", "_row.*")
    spread = big.select("chunk_id", "sdt_id", "units", F.explode(F.sequence("start_block_index", "end_block_index")).alias("block_index"))
    told = blocks.where("coalesce(text, '') <> '' AND coalesce(flow_class, '') <> 'excluded'").select(
        "sdt_id", "block_index", u16_len(F.col("text")).alias("n"), (F.col("block_type") == "heading").alias("heading")
    )
    laid = (
        spread.join(told, ["sdt_id", "block_index"])
        .groupBy("chunk_id", "units")
        .agg(F.array_sort(F.collect_set(F.struct("block_index", "n", "heading"))).alias("parts"))
        .withColumn("sum", F.aggregate("parts", F.lit(-1).cast("bigint"), lambda s, p: s + p.n + 1))
        .withColumn(
            "parts",
            F.when(F.col("sum") == F.col("units"), F.col("parts")).when(
                F.element_at("parts", 1).heading & (F.col("sum") - F.element_at("parts", 1).n - 1 == F.col("units")),
                F.slice("parts", 2, F.size("parts")),
            ),
        )
        .select(
            "chunk_id",
            F.aggregate(
                "parts",
                F.array().cast("array<struct<block_index:int,from:bigint,to:bigint>>"),
                lambda done, p: F.array_append(
                    done,
                    F.struct(
                        p.block_index.alias("block_index"),
                        F.coalesce(F.get(done, F.size(done) - 1)["to"] + 1, F.lit(0).cast("bigint")).alias("from"),
                        (F.coalesce(F.get(done, F.size(done) - 1)["to"] + 1, F.lit(0).cast("bigint")) + p.n).alias("to"),
                    ),
                ),
            ).alias("spans"),
        )
    )
    pieces = split_oversized(chunks, limits)
    hit = F.filter("spans", lambda s: (s["from"] < F.col("end_unit")) & (s["to"] > F.col("start_unit")))
    return (
        pieces.join(big.select("chunk_id", "sdt_id", "start_block_index", "end_block_index"), "chunk_id")
        .join(laid, "chunk_id", "left")
        .withColumn("hit", hit)
        .select(
            "chunk_id", "sdt_id", "piece_index", "piece_count", "start_unit", "end_unit",
            F.coalesce(F.get("hit", F.lit(0)).block_index, "start_block_index").alias("start_block_index"),
            F.coalesce(F.get("hit", F.size("hit") - 1).block_index, "end_block_index").alias("end_block_index"),
            "text",
        )
    )
