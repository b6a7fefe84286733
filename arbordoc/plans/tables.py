"""The driver's tables in the engine's own form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import table
from ..functions import refs


def distinct_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "blocks").dropDuplicates(["sdt_id", "block_index"])


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Text nodes, and the blocks above them: the top-level ones with what ``blocks`` tells, inner ones without a type."""
    texts = table(spark, folder, "text_nodes").dropDuplicates(["sdt_id", "ref"])
    none = lambda kind: F.lit(None).cast(kind)
    text_rows = texts.select(
        "sdt_id", "ref", F.lit("text").alias("kind"), none("string").alias("type"), "text", none("string").alias("flow_class"), F.lit(False).alias("is_leaf"),
        "style", F.col("stream_offset").alias("stream"), "delta_map", F.lit(0).alias("child_count"),
    )
    tops = distinct_blocks(spark, folder).select("sdt_id", F.array("block_index").alias("ref"), F.col("block_type").alias("type"), "flow_class")
    leaves = texts.groupBy("sdt_id", refs.parent(F.col("ref")).alias("ref")).agg(F.count("*").cast("int").alias("child_count")).withColumn("is_leaf", F.lit(True))
    inner = leaves.select("sdt_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("ref")), lambda n: F.slice(F.col("ref"), F.lit(1), n))).alias("ref"))
    places = inner.unionByName(tops.select("sdt_id", "ref")).distinct()
    parents = places.where(F.size("ref") > 1).select("sdt_id", refs.parent(F.col("ref")).alias("ref")).distinct().withColumn("_holds", F.lit(True))
    block_rows = (
        places.join(tops, ["sdt_id", "ref"], "left")
        .join(leaves, ["sdt_id", "ref"], "left")
        .join(parents, ["sdt_id", "ref"], "left")
        .select(
            "sdt_id", "ref", F.lit("block").alias("kind"), "type", none("string").alias("text"), "flow_class", F.col("_holds").isNull().alias("is_leaf"),
            none("struct<bold:boolean,italic:boolean,sub:boolean,sup:boolean,monospace:boolean>").alias("style"), none("bigint").alias("stream"),
            none("string").alias("delta_map"), F.coalesce("child_count", F.when(F.col("_holds"), 1).otherwise(0)).alias("child_count"),
        )
    )
    rows = text_rows.unionByName(block_rows)
    return rows.select(
        "*", refs.ref_end(F.col("ref")).alias("ref_end"), refs.parent(F.col("ref")).alias("parent_ref"), F.size("ref").alias("depth"),
        F.element_at("ref", -1).alias("ordinal"), F.get("ref", F.lit(0)).alias("top_index"), none("string").alias("text_map"),
        none("string").alias("selector_map"), none("array<array<double>>").alias("page_rects"), none("array<array<int>>").alias("refs"),
        none("array<array<int>>").alias("back_refs"), none("string").alias("target"), none("array<int>").alias("previous_part"), none("array<int>").alias("next_part"),
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "page_info").dropDuplicates(["sdt_id", "page_index"]).select("sdt_id", "page_index", "range_start", "range_end", "page_label", "text_source")


def with_parts(node_rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Nodes in which a paragraph that ends a page is continued by the paragraph that begins the next page."""
    paragraphs = blocks.where("block_type = 'paragraph' AND page_index IS NOT NULL").select("sdt_id", "block_index", "page_index")
    after = paragraphs.select("sdt_id", (F.col("block_index") - 1).alias("block_index"), (F.col("page_index") - 1).alias("page_index"))
    links = paragraphs.join(after, ["sdt_id", "block_index", "page_index"], "left_semi")
    forward = links.select("sdt_id", F.array("block_index").alias("ref"), F.array(F.col("block_index") + 1).alias("next_part"))
    back = forward.select("sdt_id", F.col("next_part").alias("ref"), F.col("ref").alias("previous_part"))
    return node_rows.drop("next_part", "previous_part").join(forward, ["sdt_id", "ref"], "left").join(back, ["sdt_id", "ref"], "left")
