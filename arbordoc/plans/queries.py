"""The engine's own queries over the driver's tables, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import cut, discard, scratch, table
from ..functions import cfi, deltamap, glyphs
from ..functions.utf16 import u16_len
from ..operators import chunker, dom, fulltext, incremental, merge, parts, ranges, retrieval, text
from ..operators import outline as outlines
from ..operators.carry import carry_forward
from ..sources import pack, trees
from . import derived, oracle, tables

KEY = "sdt_id"

#: The feed of tree deliveries: a tree's current row has the latest instant, then the highest version, then the smallest id.
DELIVERIES = incremental.Feed(
    key="sdt_id",
    record="feed_id",
    arrived="arrived_at",
    content=("lower(source_hash)", "processor_version"),
    rank=("try_cast(date_created AS timestamp)", "processor_version", "-feed_id"),
    usable="source_hash IS NOT NULL",
)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """What each succeeded run has to process: the trees that are new or changed since the one before."""
    state = scratch(spark, "feed-state")
    done = incremental.replay(table(spark, folder, "sdt_feed"), DELIVERIES, table(spark, folder, "runs"), state)
    told = cut(done.select(F.col("run").alias("run_id"), F.col("record").alias("feed_id")))
    discard(spark, state)
    return told


def outline_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The outline with parents, depths and paths."""
    entries = outlines.paths_from_levels(table(spark, folder, "outline"), KEY)
    return entries.select(KEY, "ord", "parent_ord", "depth", outlines.outline_path().alias("outline_path"))


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    entries = outlines.paths_from_levels(table(spark, folder, "outline"), KEY)
    return entries.select(KEY, "ord", F.get("ref", F.lit(0)).alias("block_index"), outlines.outline_path().alias("outline_path"))


def section_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The section chunks of every tree."""
    return chunker.section_chunks(table(spark, folder, "blocks"), _entries(spark, folder), KEY).drop("page_rects")


def next_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The first chunk of every tree."""
    return chunker.next_chunk(section_chunks(spark, folder), KEY).select(KEY, "start_block_index", "end_block_index", "text")


def next_chunks_from(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk at or behind several starts in every tree: its first block and every fifth."""
    blocks = table(spark, folder, "blocks")
    starts = blocks.where("block_index % 5 = 0").select(KEY, F.col("block_index").alias("from_block_index"))
    found = chunker.next_chunk_from(blocks, _entries(spark, folder), starts, KEY)
    return found.select(KEY, "from_block_index", "start_block_index", "end_block_index", "leaf_block_count", "outline_path", "text")


def outline_export(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of every outline that an export keeps."""
    entries = outlines.paths_from_levels(table(spark, folder, "outline"), KEY)
    told = entries.withColumn("titled", ~F.exists("title_path", lambda t: t == "")).withColumn("url", F.lit(None).cast("string")).withColumn("position", F.lit(None).cast("string"))
    return outlines.exported_entries(told, KEY).select(KEY, "ord", "title", "start_ref", "entry_source")


def last_heading(spark: SparkSession, folder: str) -> DataFrame:
    """The outline path in force at every block."""
    entries = _entries(spark, folder).where("block_index IS NOT NULL").groupBy(KEY, "block_index").agg(F.max_by("outline_path", "ord").alias("p"))
    rows = tables.distinct_blocks(spark, folder).select(KEY, "block_index").join(entries, [KEY, "block_index"], "left")
    return carry_forward(rows, KEY, "block_index", F.col("p"), "outline_path").select(KEY, "block_index", "outline_path")


def block_plain_text(spark: SparkSession, folder: str) -> DataFrame:
    """Nested plain text of every top-level block, from its text nodes."""
    told = text.nested_texts(tables.nodes(spark, folder), KEY, top_level_only=True)
    return told.select(KEY, F.get("ref", F.lit(0)).alias("block_index"), "text")


def page_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The top-level blocks that each page covers."""
    counts = tables.distinct_blocks(spark, folder).groupBy(KEY).agg((F.max("block_index") + 1).alias("block_count"))
    return ranges.page_spans(tables.pages(spark, folder), counts, KEY)


def page_leaf_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The leaf blocks of every page."""
    covered = ranges.leaves_in_ranges(tables.nodes(spark, folder), tables.pages(spark, folder), KEY)
    return covered.select(KEY, "page_index", F.array_join("ref", ",").alias("ref"))


def page_fulltext(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every page."""
    return fulltext.page_texts(cut(tables.nodes(spark, folder)), tables.pages(spark, folder), KEY).select(KEY, "page_index", "text")


def document_fulltext(spark: SparkSession, folder: str) -> DataFrame:
    """The text of all pages of a tree, paragraphs joined over page ends."""
    linked = cut(tables.with_parts(tables.nodes(spark, folder), tables.distinct_blocks(spark, folder)))
    pages = tables.pages(spark, folder)
    requests = pages.select(KEY, F.lit(0).alias("request_id"), F.col("page_index").alias("position"), "page_index")
    return fulltext.fulltext(linked, pages, requests, KEY).select(KEY, "text")


def part_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs continued over page ends as logical texts."""
    linked = cut(tables.with_parts(tables.nodes(spark, folder), tables.distinct_blocks(spark, folder)))
    told = parts.logical_texts(linked, key=KEY)
    return told.select(KEY, F.get("root", F.lit(0)).alias("root"), F.size("refs").alias("parts"), "text")


def merged_text_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring text nodes of equal anchors and looks as one."""
    merged = merge.merge_text_nodes(tables.nodes(spark, folder), KEY)
    return merged.select(KEY, F.array_join("parent_ref", ",").alias("parent_ref"), "first_ordinal", "count", "text")


def text_node_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Where every text node stands in its top-level block's text."""
    placed = text.text_positions(tables.nodes(spark, folder), KEY)
    return placed.select(KEY, F.array_join("ref", ",").alias("ref"), "start", "end")


def text_nodes_at(spark: SparkSession, folder: str) -> DataFrame:
    """The text nodes at units 10 to 40 of every block."""
    asked = tables.distinct_blocks(spark, folder).select(KEY, F.array("block_index").alias("root_ref"), F.lit(10).alias("offset_start"), F.lit(40).alias("offset_end"))
    hit = text.text_nodes_at(tables.nodes(spark, folder), asked, KEY)
    return hit.select(KEY, F.array_join("ref", ",").alias("ref"), "offset", "end_offset")


def next_block_refs(spark: SparkSession, folder: str) -> DataFrame:
    """The block after every block in document order."""
    told = text.next_block_refs(tables.nodes(spark, folder), KEY)
    return told.select(KEY, F.array_join("ref", ",").alias("ref"), F.array_join("next_ref", ",").alias("next_ref"))


def delta_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Where the last position of every mapped text node comes from."""
    nodes = table(spark, folder, "text_nodes").where("delta_map IS NOT NULL").select("node_id", "text", "delta_map").distinct()
    return nodes.select("node_id", deltamap.to_source_col(F.col("delta_map"), u16_len(F.col("text")).cast("bigint")).alias("source_position"))


def cfi_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """The fragment of every block of an e-book."""
    blocks = tables.distinct_blocks(spark, folder).where("processor_type = 'epub' AND selector_map LIKE '/%' AND text <> ''")
    value = cfi.resolve(F.col("selector_map"), F.lit(0), u16_len(F.col("text")))
    return blocks.select(KEY, "block_index", value.value.alias("fragment"))


def cfi_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The fragment from each block of an e-book to the end of the next one."""
    blocks = tables.distinct_blocks(spark, folder).where("processor_type = 'epub' AND selector_map LIKE '/%' AND text <> ''").select(KEY, "block_index", "selector_map", "text")
    after = blocks.select(KEY, (F.col("block_index") - 1).alias("block_index"), F.col("selector_map").alias("next_map"), u16_len(F.col("text")).alias("n"))
    pairs = blocks.join(after, [KEY, "block_index"])
    return pairs.select(KEY, "block_index", cfi.resolve_range(F.col("selector_map"), F.lit(0), F.col("next_map"), F.col("n")).value.alias("fragment"))


def _skeleton(spark: SparkSession, folder: str) -> DataFrame:
    """A flat page skeleton of every snapshot: its blocks' elements in order, with the stretch of text each holds."""
    from pyspark.sql.window import Window

    nodes = table(spark, folder, "text_nodes").where("stream_offset IS NOT NULL").dropDuplicates(["node_id"])
    held = nodes.groupBy(KEY, "block_index").agg(F.min("stream_offset").alias("a"), F.max(F.col("stream_offset") + u16_len(F.col("text"))).alias("b"))
    blocks = tables.distinct_blocks(spark, folder).where("processor_type = 'snapshot'").select(KEY, "block_index", F.regexp_extract("selector_map", "([a-z0-9]+)(?::nth-child\\(\\d+\\))?$", 1).alias("tag"))
    blocks = blocks.where("tag <> ''").join(held, [KEY, "block_index"])
    same, all_ = Window.partitionBy(KEY, "tag").orderBy("block_index"), Window.partitionBy(KEY).orderBy("block_index")
    back, all_back = Window.partitionBy(KEY, "tag").orderBy(F.desc("block_index")), Window.partitionBy(KEY).orderBy(F.desc("block_index"))
    flags = F.when(F.row_number().over(same) == 1, 1).otherwise(0) + F.when(F.row_number().over(back) == 1, 2).otherwise(0) + F.when(F.row_number().over(all_back) == 1, 4).otherwise(0)
    return blocks.select(
        KEY, F.col("block_index").alias("node_no"), F.lit(None).cast("int").alias("parent_no"), F.lit(0).alias("depth"), (F.row_number().over(all_) - 1).alias("sibling"), "tag",
        (F.row_number().over(all_) - 1).alias("index"), flags.alias("flags"), F.lit(None).cast("string").alias("element_id"), F.lit(None).cast("string").alias("previous_id"),
        F.col("a").alias("text_start"), (F.col("b") - F.col("a")).alias("text_length"),
    )


def dom_selectors(spark: SparkSession, folder: str) -> DataFrame:
    """A selector for every element of the page skeletons."""
    return dom.selectors(_skeleton(spark, folder), KEY)


def dom_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The elements that the skeletons' own selectors match."""
    skeleton = _skeleton(spark, folder)
    return dom.match_selectors(skeleton, dom.selectors(skeleton, KEY).select(KEY, "selector"), KEY)


def dom_holders(spark: SparkSession, folder: str) -> DataFrame:
    """The element that holds each text node's first unit."""
    nodes = table(spark, folder, "text_nodes").where("stream_offset IS NOT NULL").dropDuplicates(["node_id"])
    asked = nodes.select("node_id", KEY, F.col("stream_offset").alias("start"), (F.col("stream_offset") + 1).alias("end"))
    return dom.containing(_skeleton(spark, folder), asked, KEY).select("node_id", "node_no")


def rect_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks' first blocks that meet the rectangles of every hundredth chunk of their tree."""
    chunks = table(spark, folder, "chunks").where("processor_type = 'pdf' AND page_rects IS NOT NULL").dropDuplicates(["chunk_id"])
    drawn = chunks.groupBy(KEY, "start_block_index").agg(F.flatten(F.collect_list("page_rects")).alias("page_rects"))
    leaves = drawn.select(
        KEY, F.array("start_block_index").alias("ref"), F.array(F.col("start_block_index") + 1).alias("ref_end"), F.col("start_block_index").alias("top_index"),
        F.lit("block").alias("kind"), F.lit(True).alias("is_leaf"), "page_rects",
    )
    asked = chunks.where("chunk_id % 100 = 0").select(KEY, F.col("chunk_id").alias("request_id"), F.explode("page_rects").alias("page_rect"))
    whole = F.array(F.lit(0)), F.array(F.col("last") + 1)
    seen = drawn.select(KEY, F.explode("page_rects").alias("r"), "start_block_index").select(KEY, F.get("r", F.lit(0)).cast("int").alias("page_index"), "start_block_index")
    last = drawn.groupBy(KEY).agg(F.max("start_block_index").alias("last"))
    pages = seen.select(KEY, "page_index").distinct().join(last, KEY).select(KEY, "page_index", whole[0].alias("range_start"), whole[1].alias("range_end"))
    hit = retrieval.blocks_at_rects(leaves, pages, asked, KEY)
    return hit.select(KEY, "request_id", F.get("range_start", F.lit(0)).alias("block_index"))


def merged_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """The union of each user's activity intervals."""
    events = table(spark, folder, "events").where("value IS NOT NULL")
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    return retrieval.merge_intervals(events.select("user_id", start.alias("start"), (start + F.floor(F.abs("value") * 60)).alias("end")), ["user_id"])


def content_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every leaf block that is not excluded."""
    told = retrieval.content_sentences(tables.nodes(spark, folder), None, KEY)
    return told.select(KEY, F.array_join("ref", ",").alias("ref"), "sid", "text")


def selected_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every leaf block that is not excluded, itself or above."""
    told = retrieval.selected_texts(tables.nodes(spark, folder), None, KEY)
    return told.select(KEY, F.array_join("ref", ",").alias("ref"), "text")


def glyph_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Where the characters of runs stand: each vector's values as widths."""
    widths = F.transform("embedding", lambda e, k: F.struct(F.when(k % 5 == 1, F.lit(2.0)).alias("delta"), F.round(F.abs(e) * 1000).cast("double").alias("width")))
    zero = F.lit(0.0)
    run = F.struct(F.lit(0).alias("header"), F.lit(0).alias("page_index"), zero.alias("min_x"), zero.alias("min_y"), zero.alias("max_x"), zero.alias("max_y"), widths.alias("widths"))
    placed = table(spark, folder, "embeddings").select("vec_id", run.alias("run")).select("vec_id", F.posexplode(glyphs.positions_col(F.col("run"))).alias("k", "p"))
    return placed.select("vec_id", "k", "p.x1", "p.x2")


def rounded_geometry(spark: SparkSession, folder: str) -> DataFrame:
    """The shortest decimals within the geometry error."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 7).alias("v"))
    return rows.select("l_orderkey", "l_linenumber", glyphs.shortest_col(F.col("v")).alias("rounded"))


def pack_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every tree's blocks, written to a pack and read back."""
    blocks = tables.distinct_blocks(spark, folder)
    ordered = F.array_sort(F.collect_list(F.struct("block_index", F.struct(F.col("block_type").alias("type"), F.array(F.struct("text")).alias("content")).alias("b"))))
    content = F.to_json(F.transform(ordered, lambda x: x.b))
    tree = F.concat(
        F.lit('{"schemaVersion":"1.2.0","metadata":{"processor":{"type":"pdf","version":1},"dateCreated":"2031-01-01T00:00:00Z","source":{"contentType":"text/plain","hash":"'),
        F.md5(F.col(KEY).cast("string")), F.lit('"}},"catalog":{"pages":[]},"content":'), content, F.lit("}"),
    )
    grouped = blocks.groupBy(KEY).agg(tree.alias("tree"))
    packed = pack.pack_trees(grouped, KEY)
    back = trees.flatten(pack.unpack_trees(packed, KEY).where("tree IS NOT NULL"), "nodes", KEY)
    return back.where("kind = 'text'").select(KEY, F.col("top_index").alias("block_index"), "text")


QUERIES = {
    "section_chunks": section_chunks,
    "next_chunks": next_chunks,
    "next_chunks_from": next_chunks_from,
    "outline_paths": outline_paths,
    "outline_export": outline_export,
    "last_heading": last_heading,
    "block_plain_text": block_plain_text,
    "page_spans": page_spans,
    "page_leaf_blocks": page_leaf_blocks,
    "page_fulltext": page_fulltext,
    "document_fulltext": document_fulltext,
    "part_texts": part_texts,
    "merged_text_nodes": merged_text_nodes,
    "text_node_spans": text_node_spans,
    "text_nodes_at": text_nodes_at,
    "next_block_refs": next_block_refs,
    "delta_sources": delta_sources,
    "cfi_fragments": cfi_fragments,
    "cfi_ranges": cfi_ranges,
    "dom_selectors": dom_selectors,
    "dom_matches": dom_matches,
    "dom_holders": dom_holders,
    "rect_blocks": rect_blocks,
    "merged_intervals": merged_intervals,
    "content_sentences": content_sentences,
    "selected_texts": selected_texts,
    "glyph_positions": glyph_positions,
    "rounded_geometry": rounded_geometry,
    "pack_roundtrip": pack_roundtrip,
    "p5_found": p5_found,
}
QUERIES |= derived.QUERIES
ORACLE = {**oracle.ORACLE, **derived.ORACLE}
FLAGSHIP = "section_chunks"
