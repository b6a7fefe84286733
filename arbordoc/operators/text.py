"""Plain text of blocks, at any level of the tree."""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import refs
from ..functions.utf16 import u16_len, u16_slice


def leaf_texts(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ref, text) of every leaf block: its direct texts put together; '' for leaves without text."""
    texts = nodes.where("kind = 'text'").groupBy(key, F.col("parent_ref").alias("ref")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("t"))
    joined = texts.select(key, "ref", F.array_join(F.transform("t", lambda x: x.text), "").alias("text"))
    leaves = nodes.where("kind = 'block' AND is_leaf").select(key, "ref")
    return leaves.join(joined, [key, "ref"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def nested_texts(nodes: DataFrame, key: str = "doc_id", top_level_only: bool = False) -> DataFrame:
    """(key, ref, text, leaf_count) of every block: the texts of the leaves under it that have any, joined by newlines.

    Texts that stand beside child blocks do not count.  ``leaf_count`` is the number of text nodes and of
    empty blocks under the block, as the chunker counts.  A text node's own text is no block and not listed.
    """
    leaves = leaf_texts(nodes, key)
    spread = leaves.select(key, F.col("ref").alias("leaf"), "text")
    ancestors = F.array(F.slice("leaf", 1, 1)) if top_level_only else F.transform(F.sequence(F.lit(1), F.size("leaf")), lambda n: F.slice(F.col("leaf"), F.lit(1), n))
    joined = (
        spread.where("text <> ''")
        .withColumn("ref", F.explode(ancestors))
        .groupBy(key, "ref")
        .agg(F.array_sort(F.collect_list(F.struct("leaf", "text"))).alias("t"))
        .select(key, "ref", F.array_join(F.transform("t", lambda x: x.text), "\n").alias("text"))
    )
    carriers = nodes.where("kind = 'text' OR child_count = 0").select(key, F.col("ref").alias("leaf"))
    counted = carriers.withColumn("ref", F.explode(ancestors)).groupBy(key, "ref").agg(F.count("*").cast("int").alias("leaf_count"))
    blocks = nodes.where("kind = 'block'" + (" AND depth = 1" if top_level_only else "")).select(key, "ref")
    return (
        blocks.join(joined, [key, "ref"], "left")
        .join(counted, [key, "ref"], "left")
        .select(key, "ref", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("leaf_count", F.lit(0)).alias("leaf_count"))
    )


def top_level_blocks(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The input of the chunker: (key, block_index, block_type, text, flow_class, leaf_block_count, page_rects)."""
    texts = nested_texts(nodes, key, top_level_only=True)
    tops = nodes.where("kind = 'block' AND depth = 1").select(key, "ref", "top_index", "type", "flow_class", "page_rects")
    return tops.join(texts, [key, "ref"]).select(
        key, F.col("top_index").alias("block_index"), F.col("type").alias("block_type"), "text", "flow_class",
        F.col("leaf_count").alias("leaf_block_count"), "page_rects",
    )


def text_positions(nodes: DataFrame, key: str = "doc_id", text: str = "text", level: int = 1) -> DataFrame:
    """Text nodes with ``start`` and ``end``: their UTF-16 offsets in the text of their ancestor at ``level`` (``root_ref``)."""
    rows = nodes.where("kind = 'text'").where(F.size("ref") > level).withColumn("root_ref", F.slice("ref", 1, level)).withColumn("units", u16_len(F.col(text)))
    order = Window.partitionBy(key, "root_ref").orderBy("ref")
    end = F.sum("units").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("units"))


def text_nodes_at(nodes: DataFrame, requests: DataFrame, key: str = "doc_id", level: int = 1) -> DataFrame:
    """The text nodes that inclusive offset ranges touch: (request columns, ref, offset, end_offset), both offsets in the node and inclusive.

    ``requests`` has key, root_ref (a block at ``level``), offset_start and offset_end; reversed ranges are
    swapped, ranges with a NULL offset touch nothing.  An empty text strictly inside a range has end offset -1.
    """
    placed = text_positions(nodes, key, level=level)
    low, high = F.least("offset_start", "offset_end"), F.greatest("offset_start", "offset_end")
    asked = requests.where("offset_start IS NOT NULL AND offset_end IS NOT NULL").withColumn("_low", low).withColumn("_high", high)
    hit = asked.join(placed.select(key, "root_ref", "ref", "start", "end", "units"), [key, "root_ref"]).where("end - 1 >= _low AND start <= _high")
    return hit.select(
        *requests.columns, "ref",
        F.greatest(F.lit(0), F.col("_low") - F.col("start")).cast("int").alias("offset"),
        F.least(F.col("units") - 1, F.col("_high") - F.col("start")).cast("int").alias("end_offset"),
    )


def next_block_refs(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ref, next_ref) of every block: the block after it in document order, NULL for the last.

    The order of a document of any size is cut in ranges of top-level blocks; only each range's first
    block is handed to the one before it.
    """
    blocks = nodes.where("kind = 'block'").select(key, "ref", F.floor(F.col("top_index") / 1_024).alias("_range"))
    inside = blocks.withColumn("_next", F.lead("ref").over(Window.partitionBy(key, "_range").orderBy("ref")))
    firsts = blocks.groupBy(key, "_range").agg(F.min("ref").alias("_first"))
    ahead = firsts.select(key, "_range", F.lead("_first").over(Window.partitionBy(key).orderBy("_range")).alias("_ahead"))
    return inside.join(ahead, [key, "_range"]).select(key, "ref", F.coalesce("_next", "_ahead").alias("next_ref"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _offsets(text: pd.Series) -> pd.Series:
    """Where each character begins, in UTF-16 units; asked only of texts in which that is not its number."""
    return text.map(lambda t: [0, *accumulate(1 + (c > "\uffff") for c in t[:-1])] if t else None)


def characters(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The character stream of documents: (key, ref, offset, char, block), one row per UTF-16 unit in reading order.

    A cursor is the place (ref, offset) behind the last character read, so the next character is the first
    row at or after it; ``block`` is the top-level block, to which a block cursor is confined.  Astral
    characters give one row at the offset of their first unit.
    """
    texts = nodes.where("kind = 'text' AND text <> ''").select(key, "ref", F.col("top_index").alias("block"), "text", _offsets(F.when(u16_len(F.col("text")) > F.length("text"), F.col("text"))).alias("at"))
    chars = texts.select(key, "ref", "block", "at", F.posexplode(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("k", "char"))
    return chars.select(key, "ref", F.coalesce(F.get("at", F.col("k")), F.col("k")).cast("int").alias("offset"), "char", "block")


def next_chars(nodes: DataFrame, cursors: DataFrame, key: str = "doc_id", confined: bool = False) -> DataFrame:
    """What each cursor (key, cursor_id, ref, offset) reads next: (key, cursor_id, char, next_ref, next_offset).

    A cursor at a block reads its first text; at a text's end, or at a ref that does not exist, the text
    after it; behind the last text, NULL and offset 0.  ``confined`` cursors stay in their top-level block.
    """
    at = cursors.where(F.size("ref") > 0).select(
        key, "cursor_id", F.col("ref").alias("_at"), F.greatest(F.coalesce("offset", F.lit(0)), F.lit(0)).cast("int").alias("_offset"), F.get("ref", F.lit(0)).alias("top_index")
    )
    texts = nodes.where("kind = 'text' AND text <> ''").select(key, "ref", "top_index", "text")
    mine = at.join(texts.select(key, F.col("ref").alias("_at"), F.col("text").alias("_own")), [key, "_at"], "left")
    within = F.coalesce(F.col("_offset") < u16_len(F.col("_own")), F.lit(False))
    # a cursor that is not inside a text reads the first text behind its place: of texts and cursors in order, within
    # ranges of top-level blocks, and between ranges by one row of each
    span = F.col("top_index") if confined else F.floor(F.col("top_index") / 1_024)
    none = lambda kind: F.lit(None).cast(kind)
    hit = F.struct("ref", "text")
    lines = texts.select(key, span.alias("_span"), F.col("ref").alias("_place"), F.lit(1).alias("_kind"), hit.alias("_hit"), none("array<int>").alias("_at"), none("int").alias("_offset"), none(cursors.schema["cursor_id"].dataType).alias("cursor_id"), none("string").alias("_own"))
    asked = mine.select(key, span.alias("_span"), F.col("_at").alias("_place"), F.lit(2).alias("_kind"), none("struct<ref:array<int>,text:string>").alias("_hit"), "_at", "_offset", "cursor_id", F.when(within, F.col("_own")).alias("_own"))
    both = lines.unionByName(asked)
    order = Window.partitionBy(key, "_span").orderBy("_place", "_kind").rowsBetween(1, Window.unboundedFollowing)
    told = both.withColumn("_next", F.first("_hit", ignorenulls=True).over(order)).where("_kind = 2")
    if not confined:
        firsts = both.groupBy(key, "_span").agg(F.min(F.when(F.col("_hit").isNotNull(), F.struct(F.col("_place").alias("ref"), F.col("_hit.text").alias("text")))).alias("_first"))
        later = Window.partitionBy(key).orderBy("_span").rowsBetween(1, Window.unboundedFollowing)
        ahead = firsts.select(key, "_span", F.first("_first", ignorenulls=True).over(later).alias("_ahead"))
        told = told.join(ahead, [key, "_span"]).withColumn("_next", F.coalesce("_next", "_ahead"))
    here = F.when(F.col("_own").isNotNull(), F.struct(F.col("_at").alias("ref"), F.col("_own").alias("text"))).otherwise(F.col("_next"))
    start = F.when(F.col("_own").isNotNull(), F.col("_offset")).otherwise(0)
    read = told.withColumn("_hit", here).select(
        key, "cursor_id", u16_slice(F.col("_hit.text"), start, start + 1).alias("char"), F.col("_hit.ref").alias("next_ref"), F.when(F.col("_hit").isNotNull(), start + 1).cast("int").alias("next_offset")
    )
    return cursors.select(key, "cursor_id").join(read, [key, "cursor_id"], "left").withColumn("next_offset", F.coalesce("next_offset", F.lit(0)))
