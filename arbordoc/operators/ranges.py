"""Half-open content ranges: which leaf blocks they cover, and where their boundaries point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import refs


def block_counts(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    return nodes.groupBy(key).agg((F.max("top_index") + 1).alias("block_count"))


def page_spans(pages: DataFrame, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page_index, start_index, end_index): top-level blocks of every page, end exclusive; NULLs where the range is invalid."""
    span = refs.block_span(F.col("range_start"), F.col("range_end"), F.coalesce("block_count", F.lit(0)))
    told = pages.join(counts.select(key, "block_count"), key, "left").withColumn("_span", span)
    return told.select(key, "page_index", "_span.start_index", "_span.end_index")


def leaves_in_ranges(nodes: DataFrame, ranges: DataFrame, key: str = "doc_id", counts: DataFrame | None = None) -> DataFrame:
    """(columns of ranges, ref): the leaf blocks that each range (key, range_start, range_end) covers.

    A leaf is covered if it ends behind the start and begins before the end.  The range's top-level blocks
    are spelled out, so leaves are found by an equality join on (document, top-level block); the exact
    comparison follows.  Invalid ranges and empty ones cover nothing.
    """
    counts = block_counts(nodes, key) if counts is None else counts
    span = refs.block_span(F.col("range_start"), F.col("range_end"), F.col("block_count"))
    spread = (
        ranges.join(counts.select(key, "block_count"), key)
        .withColumn("_span", span)
        .where("_span IS NOT NULL AND _span.start_index < _span.end_index")
        .withColumn("_top", F.explode(F.sequence(F.col("_span.start_index"), F.col("_span.end_index") - 1)))
        .drop("_span", "block_count")
    )
    leaves = nodes.where("kind = 'block' AND is_leaf").select(key, F.col("top_index").alias("_top"), F.col("ref").alias("_leaf"), F.col("ref_end").alias("_leaf_end"))
    hit = spread.join(leaves, [key, "_top"]).where((F.col("_leaf_end") > F.col("range_start")) & (F.col("_leaf") < F.col("range_end")))
    return hit.drop("_top", "_leaf_end").withColumnRenamed("_leaf", "ref")


def split_points(points: DataFrame, nodes: DataFrame, key: str = "doc_id", column: str = "point") -> DataFrame:
    """The points with ``point_ref`` and ``point_offset``: the last index is a text offset if what is before it is a text node."""
    texts = nodes.where("kind = 'text'").select(key, F.col("ref").alias("_parent"), F.lit(True).alias("_in_text"))
    joined = points.withColumn("_parent", refs.parent(F.col(column))).join(texts, [key, "_parent"], "left")
    inside = F.coalesce("_in_text", F.lit(False))
    return (
        joined.withColumn("point_ref", F.when(inside, F.col("_parent")).otherwise(F.col(column)))
        .withColumn("point_offset", F.when(inside, F.element_at(F.col(column), -1)))
        .drop("_parent", "_in_text")
    )


def nodes_at(nodes: DataFrame, requests: DataFrame, key: str = "doc_id") -> DataFrame:
    """The requests (key, ref, ...) with ``kind``, ``type``, ``text`` and ``child_count`` of the node that each ref names; all NULL where there is none.

    NULL, empty and negative refs, and refs behind the last child, name no node.
    """
    told = nodes.select(key, "ref", "kind", "type", "text", "child_count")
    return requests.join(told, [key, "ref"], "left").select(*requests.columns, "kind", "type", "text", "child_count")
