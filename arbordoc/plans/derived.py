"""Queries on trees that are made of the driver's tables by rule, for what these do not have: page skeletons of several
levels with ids, selector maps of several entries, glyph runs, rectangles, packs and edits; and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import cut, discard, scratch, table
from ..functions import cfi, deltamap, refs
from ..functions.utf16 import BLANKS_TEXT, u16_len
from ..operators import chunker, dom, edits, glyph_tables, merge, parts, ranges, retrieval, text
from ..operators import outline as outlines
from ..sources import pack, trees
from . import tables
from .oracle import _BLOCKS, _ENTRIES, _JS_BLANKS, _LEAVES, _LINKS, _PAGES, _REFS, _SEAM, _TEXTS, _units

KEY = "sdt_id"


def _key(ref: str = "ref") -> Column:
    return F.array_join(ref, ",")


# ---- nodes, ranges, cursors


def node_lookups(spark: SparkSession, folder: str) -> DataFrame:
    """The node of every outline entry's ref, the first child of it, and a child that is not there."""
    entries = table(spark, folder, "outline").where("ref IS NOT NULL").dropDuplicates([KEY, "ord"])
    ways = {"own": F.col("ref"), "below": F.array_append("ref", 0), "beyond": F.array_append("ref", 99_999)}
    asked = entries.select(KEY, "ord", F.explode(F.array(*(F.struct(F.lit(k).alias("what"), v.alias("ref")) for k, v in ways.items()))).alias("a")).select(KEY, "ord", "a.*")
    return ranges.nodes_at(tables.nodes(spark, folder), asked, KEY).select(KEY, "ord", "what", "kind", F.col("type").alias("block_type"))


def range_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Page ranges made from points, with their start moved to a text offset and their end to the start."""
    pages = tables.pages(spark, folder).where("range_start IS NOT NULL AND range_end IS NOT NULL")
    own = refs.range_of(F.col("range_start"), F.col("range_end"), end_offset=F.lit(7))
    moved = refs.with_end(refs.with_start(own, refs.point(F.col("range_end"), F.lit(3))), F.col("range_start"))
    return pages.select(KEY, "page_index", *(refs.ref_key(r[c]).alias(n) for n, r, c in (("own_start", own, "range_start"), ("own_end", own, "range_end"), ("start", moved, "range_start"), ("end", moved, "range_end"))))


def cursor_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Where a cursor at the end of each text, and one at the beginning of each block, reads on, in the document and within its block."""
    nodes = cut(tables.nodes(spark, folder))
    ends = nodes.where("kind = 'text'").select(KEY, F.concat(F.lit("end "), _key()).alias("cursor_id"), "ref", u16_len(F.col("text")).cast("int").alias("offset"))
    starts = nodes.where("kind = 'block'").select(KEY, F.concat(F.lit("block "), _key()).alias("cursor_id"), "ref", F.lit(0).alias("offset"))
    asked = ends.unionByName(starts)
    free, confined = text.next_chars(nodes, asked, KEY), text.next_chars(nodes, asked, KEY, confined=True)
    told = free.select(KEY, "cursor_id", _key("next_ref").alias("next_ref"), "next_offset")
    return told.join(confined.select(KEY, "cursor_id", _key("next_ref").alias("next_in_block")), [KEY, "cursor_id"])


# ---- position maps and fragments


def _mapped(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "text_nodes").where("delta_map IS NOT NULL AND delta_map <> ''")
    return rows.select("node_id", KEY, "block_index", "ref", "delta_map", u16_len(F.col("text")).cast("bigint").alias("n")).distinct()


def delta_composed(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh position of each mapped text led through its map twice, by the composed map."""
    told = _mapped(spark, folder).withColumn("twice", deltamap.compose_col("delta_map", "delta_map", "n"))
    at = told.select("node_id", "twice", F.explode(F.sequence(F.lit(0).cast("bigint"), "n", F.lit(7).cast("bigint"))).alias("position"))
    return at.select("node_id", "position", deltamap.to_source_col(F.col("twice"), F.col("position")).alias("source_position"))


def delta_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh position of each two mapped texts of a block set one after the other, by the merged map."""
    order = Window.partitionBy(KEY, "block_index").orderBy("ref", "node_id")
    pairs = _mapped(spark, folder).withColumn("next_map", F.lead("delta_map").over(order)).withColumn("next_n", F.lead("n").over(order)).where("next_map IS NOT NULL")
    told = pairs.withColumn("both", deltamap.merge_col("delta_map", "next_map", "n"))
    at = told.select("node_id", "both", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") + F.col("next_n"), F.lit(7).cast("bigint"))).alias("position"))
    return at.select("node_id", "position", deltamap.to_source_col(F.col("both"), F.col("position")).alias("source_position"))


def cfi_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The fragment of each e-book block of several texts but for its first and last unit, by a map with an entry for each text."""
    blocks = tables.distinct_blocks(spark, folder).where("processor_type = 'epub' AND selector_map LIKE '/%'").select(KEY, "block_index", "selector_map")
    texts = table(spark, folder, "text_nodes").where("text <> ''").dropDuplicates([KEY, "ref"]).select(KEY, "block_index", "ref", u16_len(F.col("text")).alias("n"))
    order = Window.partitionBy(KEY, "block_index").orderBy("ref")
    lines = texts.join(blocks, [KEY, "block_index"]).withColumn("k", F.row_number().over(order))
    entry = F.concat(F.col("n").cast("string"), F.lit(" "), F.col("selector_map"), F.lit("/"), (2 * F.col("k") - 1).cast("string"))
    maps = lines.groupBy(KEY, "block_index").agg(F.array_sort(F.collect_list(F.struct("k", entry.alias("e")))).alias("e"), F.sum("n").alias("n")).where("size(e) > 1 AND n > 3")
    joined = F.array_join(F.transform("e", lambda x: x.e), "\n")
    return maps.select(KEY, "block_index", cfi.resolve(joined, F.lit(1), F.col("n") - 1).value.alias("fragment"))


def merged_selector_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring texts of e-books of equal looks as one, with their paths as entries of one map."""
    epub = tables.distinct_blocks(spark, folder).where("processor_type = 'epub'").select(KEY, F.col("block_index").alias("top_index"))
    path = F.concat(F.lit("/4/"), F.col("top_index").cast("string"), F.lit("/"), (2 * F.col("ordinal") + 1).cast("string"))
    nodes = tables.nodes(spark, folder).join(epub, [KEY, "top_index"]).where("kind = 'text'")
    nodes = nodes.withColumn("selector_map", path).withColumn("delta_map", F.lit(None).cast("string")).withColumn("stream", F.lit(None).cast("bigint"))
    return merge.merge_selector_maps(nodes, KEY).select(KEY, _key("parent_ref").alias("parent_ref"), "first_ordinal", "count", "selector_map")


# ---- glyph runs


def _with_runs(nodes: DataFrame, width: str = "5", header: Column | None = None) -> DataFrame:
    """Texts with one glyph run each: a glyph for every unit that is no blank."""
    inked = u16_len(F.regexp_replace("text", "[ \\n\\t]", "")).cast("int")
    box = F.concat((inked * F.lit(float(width))).cast("string"), F.lit(",10"))
    run = F.concat(F.lit("[["), (F.lit(0) if header is None else header).cast("string"), F.lit(","), F.col("top_index").cast("string"), F.lit(",0,0,"), box, F.repeat(F.lit("," + width), inked), F.lit("]]"))
    return nodes.withColumn("text_map", F.when(F.col("kind") == "text", run))


def glyph_units(spark: SparkSession, folder: str) -> DataFrame:
    """Per block: how many units have a glyph, where the last ends and what their beginnings add up to."""
    units = glyph_tables.block_units(_with_runs(tables.nodes(spark, folder)), KEY).where("x1 IS NOT NULL")
    return units.groupBy(KEY, F.get("root_ref", F.lit(0)).alias("block_index")).agg(
        F.count("*").alias("glyphs"), F.max("x2").alias("last"), F.sum("x1").alias("beginnings"), F.max("page_index").alias("page_index")
    )


def run_compaction(spark: SparkSession, folder: str) -> DataFrame:
    """Per tree: glyph runs of width 5.3, and whether compacting moves no glyph beyond the error allowed."""
    told = glyph_tables.compaction_errors(_with_runs(tables.nodes(spark, folder), "5.3"), KEY)
    # a run without widths is one character, its box
    return told.select(KEY, "runs", "characters", (F.col("max_error") <= 0.25 + 1e-9).alias("within"))


def merged_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring texts of equal looks as one, with their runs one behind the other."""
    merged = merge.merge_runs(_with_runs(tables.nodes(spark, folder)), KEY)
    return merged.select(KEY, _key("parent_ref").alias("parent_ref"), "first_ordinal", "count", F.size(F.from_json("text_map", "array<string>")).alias("runs"))


def soft_part_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Logical texts where every second part ends in a soft hyphen of the layout."""
    linked = tables.with_parts(tables.nodes(spark, folder), tables.distinct_blocks(spark, folder))
    soft = cut(_with_runs(linked, header=F.when(F.col("top_index") % 2 == 0, 1).otherwise(0)))
    return parts.logical_texts(soft, key=KEY).select(KEY, F.get("root", F.lit(0)).alias("root"), F.size("refs").alias("parts"), "text")


def encoded_names(spark: SparkSession, folder: str) -> DataFrame:
    """Part names set as characters of a line and encoded as text nodes with glyph runs."""
    names = table(spark, folder, "part").select("p_partkey", "p_name")
    chars = names.select("p_partkey", "p_name", F.posexplode(F.split("p_name", "")).alias("k", "c")).where("c <> ' ' AND c <> ''")
    known = {
        "doc_id": F.col("p_partkey").cast("string"), "page_index": F.lit(0), "block_no": F.lit(0), "char_no": F.col("k"), "c": F.col("c"),
        "rect": F.array(F.col("k") * 5.0, F.lit(0.0), F.col("k") * 5.0 + 5.0, F.lit(10.0)), "axis_dir": F.lit(0), "space_after": F.substring(F.col("p_name"), F.col("k") + 2, F.lit(1)) == " ",
    }
    fields = [f.split(" ") for f in glyph_tables.CHARACTERS.split(", ")]
    told = chars.select(*(known.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))
    encoded = glyph_tables.encode_characters(told)
    glyphs = F.size(F.from_json(F.get(F.from_json("text_map", "array<string>"), F.lit(0)), "array<string>")) - 6
    return encoded.select(F.col("doc_id").cast("bigint").alias("p_partkey"), "text", glyphs.alias("glyphs"))


# ---- page skeletons of three levels


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of six blocks, every second with an id; the blocks' elements; a span for each text."""
    blocks = tables.distinct_blocks(spark, folder).where("processor_type = 'snapshot'").select(
        KEY, "block_index", F.floor(F.col("block_index") / 6).cast("int").alias("g"), F.regexp_extract("selector_map", "([a-z0-9]+)(?::nth-child\\(\\d+\\))?$", 1).alias("tag")
    )
    texts = table(spark, folder, "text_nodes").where("stream_offset IS NOT NULL AND text <> ''").dropDuplicates(["node_id"])
    spans = texts.join(blocks.where("tag <> ''").select(KEY, "block_index", "g"), [KEY, "block_index"]).withColumn("z", F.col("stream_offset") + u16_len(F.col("text")))
    spans = cut(spans.select(KEY, "g", "block_index", "ref", "node_id", F.col("stream_offset").alias("a"), "z"))
    held = spans.groupBy(KEY, "g", "block_index").agg(F.min("a").alias("a"), F.max("z").alias("z")).join(blocks.drop("g"), [KEY, "block_index"])
    whole = held.groupBy(KEY, "g").agg(F.min("a").alias("a"), F.max("z").alias("z"))

    def levelled(rows: DataFrame, under: list[str], order: str, tag: Column, number: Column, parent: Column, depth: int, element_id: Column) -> DataFrame:
        rows = rows.withColumn("tag", tag)
        same, every = Window.partitionBy(*under, "tag"), Window.partitionBy(*under)
        place = F.row_number().over(every.orderBy(order)) - 1
        flags = F.when(F.row_number().over(same.orderBy(order)) == 1, 1).otherwise(0) + F.when(F.row_number().over(same.orderBy(F.desc(order))) == 1, 2).otherwise(0)
        flags = flags + F.when(F.row_number().over(every.orderBy(F.desc(order))) == 1, 4).otherwise(0)
        return rows.select(
            KEY, number.cast("int").alias("node_no"), parent.cast("int").alias("parent_no"), F.lit(depth).alias("depth"), place.alias("sibling"), "tag", place.alias("index"), flags.alias("flags"),
            element_id.alias("element_id"), F.lag(element_id).over(every.orderBy(order)).alias("previous_id"), F.col("a").alias("text_start"), (F.col("z") - F.col("a")).alias("text_length"),
        )

    section = F.col("g") * 100_000
    block = section + 1 + (F.col("block_index") - 6 * F.col("g")) * 10_000
    ranked = spans.withColumn("i", F.row_number().over(Window.partitionBy(KEY, "block_index").orderBy("ref")))
    none = F.lit(None).cast("string")
    return cut(
        levelled(whole, [KEY], "g", F.lit("section"), section, F.lit(None), 0, F.when(F.col("g") % 2 == 0, F.concat(F.lit("s"), F.col("g").cast("string"))))
        .unionByName(levelled(held, [KEY, "g"], "block_index", F.col("tag"), block, section, 1, none))
        .unionByName(levelled(ranked, [KEY, "block_index"], "i", F.lit("span"), block + F.col("i"), block, 2, none))
    )


def section_selectors(spark: SparkSession, folder: str) -> DataFrame:
    """Selectors of elements on three levels, from the nearest id on."""
    return dom.selectors(_sections(spark, folder), KEY)


def section_matches(spark: SparkSession, folder: str) -> DataFrame:
    """What those selectors match, and the sections behind one with an id, by '#id + section'."""
    elements = _sections(spark, folder)
    own = dom.selectors(elements, KEY).select(KEY, "selector")
    after = elements.where("previous_id IS NOT NULL").select(KEY, F.concat(F.lit("#"), "previous_id", F.lit(" + section")).alias("selector"))
    return dom.match_selectors(elements, own.unionByName(after), KEY)


def section_holders(spark: SparkSession, folder: str) -> DataFrame:
    """The deepest element around every text."""
    texts = table(spark, folder, "text_nodes").where("stream_offset IS NOT NULL AND text <> ''").dropDuplicates(["node_id"])
    asked = texts.select("node_id", KEY, F.col("stream_offset").alias("start"), (F.col("stream_offset") + u16_len(F.col("text"))).alias("end"))
    return dom.containing(_sections(spark, folder), asked, KEY).select("node_id", "node_no")


# ---- packs


def _trees(spark: SparkSession, folder: str) -> DataFrame:
    """Each tree in JSON: its top-level blocks with their texts as direct children."""
    texts = table(spark, folder, "text_nodes").dropDuplicates([KEY, "ref"]).groupBy(KEY, "block_index").agg(F.array_sort(F.collect_list(F.struct("ref", "text"))).alias("t"))
    blocks = tables.distinct_blocks(spark, folder).select(KEY, "block_index", "block_type").join(texts, [KEY, "block_index"])
    block = F.struct(F.col("block_type").alias("type"), F.transform("t", lambda x: F.struct(x["text"].alias("text"))).alias("content"))
    content = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("block_index", block.alias("b")))), lambda x: x.b))
    front = '{"schemaVersion":"1.2.0","metadata":{"processor":{"type":"pdf","version":1},"dateCreated":"2031-01-01T00:00:00Z","source":{"contentType":"text/plain","hash":"'
    return blocks.groupBy(KEY).agg(F.concat(F.lit(front), F.md5(F.col(KEY).cast("string")), F.lit('"}},"catalog":{"pages":[]},"content":'), content, F.lit("}")).alias("tree"))


def _packs(spark: SparkSession, folder: str) -> str:
    pack.register(spark)
    path = scratch(spark, "packs")
    _trees(spark, folder).select(F.col(KEY).cast("string").alias("doc_id"), "tree").write.format("treepack").mode("append").option("path", path).save()
    return path


def pack_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks 2 to 5 of packs on disk, by the bounds that reach the reader."""
    path = _packs(spark, folder)
    read = spark.read.format("treepack").option("path", path).load().where("block_index BETWEEN 2 AND 5")
    told = cut(read.select(F.col("doc_id").cast("bigint").alias(KEY), "block_index", F.get_json_object("block", "$.type").alias("block_type")))
    discard(spark, path)
    return told


def pack_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """What the front of each pack on disk says."""
    path = _packs(spark, folder)
    read = spark.read.format("treepack").option("path", path).option("section", "metadata").load()
    told = cut(read.select(F.col("doc_id").cast("bigint").alias(KEY), "schema_version", "block_count", F.get_json_object("metadata", "$.processor.type").alias("processor_type")))
    discard(spark, path)
    return told


# ---- edits


def edited_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Trees with one edit a block: the second text in bold, or where there is one text, all but its first and last unit."""
    texts = table(spark, folder, "text_nodes").dropDuplicates([KEY, "ref"]).groupBy(KEY, "block_index").agg(F.array_sort(F.collect_list(F.struct("ref", u16_len(F.col("text")).alias("n")))).alias("t"))
    place = (F.row_number().over(Window.partitionBy(KEY).orderBy("block_index")) - 1).cast("int")
    first, second = F.get("t", F.lit(0)).n, F.get("t", F.lit(1)).n
    asked = texts.select(
        KEY, F.col("block_index").alias("edit_no"), F.array(place).alias("block_ref"), F.when(second.isNull(), 1).otherwise(first).cast("int").alias("offset_start"),
        F.when(second.isNull(), first - 2).otherwise(first + second - 1).cast("int").alias("offset_end"), F.lit("bold").alias("argument"),
    ).where("offset_end >= offset_start")
    done = edits.edit_trees(_trees(spark, folder), asked, lambda node, e: {**node, "style": {e["argument"]: True}}, KEY)
    nodes = trees.flatten(done, "nodes", KEY).where("kind = 'text'")
    return nodes.select(KEY, F.col("top_index").alias("place"), "ordinal", u16_len(F.col("text")).cast("int").alias("units"), F.coalesce("style.bold", F.lit(False)).alias("bold"))


# ---- retrieval


def selected_slices(spark: SparkSession, folder: str) -> DataFrame:
    """The first text of every leaf block, by a selection of ranges around it."""
    nodes = cut(tables.nodes(spark, folder))
    first = nodes.where("kind = 'text'").groupBy(KEY, "parent_ref").agg(F.min("ref").alias("range_start")).withColumn("range_end", refs.ref_end(F.col("range_start")))
    told = retrieval.selected_texts(nodes, first.select(KEY, "range_start", "range_end"), KEY)
    return told.select(KEY, _key().alias("ref"), "text")


def sentence_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Every leaf block's sentences set side by side, without blanks: nothing is lost or said twice."""
    told = retrieval.content_sentences(tables.nodes(spark, folder), None, KEY).where("text IS NOT NULL")
    joined = told.groupBy(KEY, _key().alias("ref")).agg(F.array_sort(F.collect_list(F.struct("sid", "text"))).alias("s"))
    blanks = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in BLANKS_TEXT) + "]+"
    return joined.select(KEY, "ref", F.regexp_replace(F.array_join(F.transform("s", lambda x: x.text), ""), blanks, "").alias("letters"))


def sentence_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """The rectangles of every leaf block of one text of plain words: one for each word, as blanks have no glyph; where the first one ends."""
    nodes = cut(_with_runs(tables.nodes(spark, folder)))
    single = nodes.where("kind = 'text'").groupBy(KEY, F.col("parent_ref").alias("ref")).agg(F.count("*").alias("n"), F.min("text").alias("text"))
    asked = single.where("n = 1 AND text RLIKE '^[A-Za-z0-9 ]*[A-Za-z0-9][A-Za-z0-9 ]*$'").select(KEY, "ref", F.lit("s0").alias("sid"))
    told = retrieval.sentence_page_rects(nodes, asked, KEY)
    rect = F.get("page_rects", F.lit(0))
    return told.select(KEY, _key().alias("ref"), F.size("page_rects").alias("rects"), F.get(rect, F.lit(0)).cast("int").alias("page_index"), F.get(rect, F.lit(3)).alias("right"))


def _drawn(spark: SparkSession, folder: str) -> DataFrame:
    blocks = tables.distinct_blocks(spark, folder)
    at = F.col("block_index").cast("double")
    rect = F.when(F.col("page_index").isNotNull(), F.array(F.array(F.col("page_index").cast("double"), F.lit(0.0), at, F.lit(10.0), at + 1)))
    return blocks.withColumn("page_rects", rect)


def rect_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """The leaf blocks under a rectangle at the top of every page, if the page's range has them."""
    drawn = cut(_drawn(spark, folder).where("page_index IS NOT NULL").select(KEY, "block_index", "page_index", "page_rects"))
    nodes = tables.nodes(spark, folder).drop("page_rects").join(drawn.select(KEY, F.col("block_index").alias("top_index"), "page_rects"), [KEY, "top_index"], "left")
    top = drawn.groupBy(KEY, "page_index").agg(F.min("block_index").cast("double").alias("k"))
    rect = F.array(F.col("page_index").cast("double"), F.lit(0.0), F.col("k") + 0.5, F.lit(1.0), F.col("k") + 2.5)
    hit = retrieval.blocks_at_rects(nodes, tables.pages(spark, folder), top.select(KEY, F.col("page_index").alias("request_id"), rect.alias("page_rect")), KEY)
    return hit.select(KEY, F.col("request_id").alias("page_index"), _key("range_start").alias("ref"))


def chunk_rects(spark: SparkSession, folder: str) -> DataFrame:
    """The rectangles of every section chunk, by page."""
    entries = outlines.paths_from_levels(table(spark, folder, "outline"), KEY)
    told = entries.select(KEY, "ord", F.get("ref", F.lit(0)).alias("block_index"), outlines.outline_path().alias("outline_path"))
    chunks = chunker.section_chunks(_drawn(spark, folder), told, KEY).where("size(page_rects) > 0")
    pages = F.array_distinct(F.transform("page_rects", lambda r: F.get(r, F.lit(0)).cast("int")))
    return chunks.select(KEY, "start_block_index", F.size("page_rects").alias("rects"), F.array_join(F.transform(pages, lambda p: p.cast("string")), ",").alias("pages"))


def outline_json(spark: SparkSession, folder: str) -> DataFrame:
    """Every tree's outline as nested JSON: its roots, and its entries however deep."""
    entries = outlines.paths_from_levels(table(spark, folder, "outline"), KEY)
    told = entries.withColumn("titled", ~F.exists("title_path", lambda t: t == "")).withColumn("url", F.lit(None).cast("string")).withColumn("position", F.lit(None).cast("string"))
    nested = outlines.export_outline(told, KEY)
    return nested.select(KEY, F.size(F.from_json("outline", "array<string>")).alias("roots"), F.regexp_count("outline", F.lit('"title":')).alias("entries"))


QUERIES = {
    f.__name__: f
    for f in (
        node_lookups, range_edges, cursor_steps, delta_composed, delta_merged, cfi_spans, merged_selector_maps, glyph_units, run_compaction, merged_runs, soft_part_texts, encoded_names,
        section_selectors, section_matches, section_holders, pack_ranges, pack_metadata, edited_trees, selected_slices, sentence_cover, sentence_boxes, rect_leaves, chunk_rects, outline_json,
    )
}

_DELTA = "coalesce(list_last(list_filter({map}, lambda x: x.p <= {at})).d, 0)"
_MAPPED = f"""
    m0 AS (SELECT DISTINCT node_id, sdt_id, block_index, ref, {_units('text')} AS n, list_transform(string_split(delta_map, ' '), lambda x: CAST(x AS BIGINT)) AS v
           FROM text_nodes WHERE delta_map IS NOT NULL AND delta_map <> ''),
    m AS (SELECT node_id, sdt_id, block_index, ref, n, list_transform(range(0, len(v) // 2), lambda k: {{'p': v[2 * k + 1], 'd': v[2 * k + 2]}}) AS f FROM m0)
"""
_INK = f"{_units(chr(123) + 'x' + chr(125))}".replace("{x}", "regexp_replace(text, '[ \\n\\t]', '', 'g')")
_PSEUDO = """CASE WHEN f AND l THEN '' WHEN i = 0 THEN ':first-child' WHEN f THEN ':first-of-type' WHEN c THEN ':last-child' WHEN l THEN ':last-of-type' ELSE ':nth-child(' || (i + 1) || ')' END"""


def _level(name: str, rows: str, under: str, order: str) -> str:
    """A level's elements with place (i), first and last of type (f, l) and last child (c)."""
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY {under} ORDER BY {order}) - 1 AS i, row_number() OVER (PARTITION BY {under}, tag ORDER BY {order}) = 1 AS f,
        row_number() OVER (PARTITION BY {under}, tag ORDER BY {order} DESC) = 1 AS l, row_number() OVER (PARTITION BY {under} ORDER BY {order} DESC) = 1 AS c FROM ({rows}))"""


_SECTIONS = f"""
    sb AS (SELECT sdt_id, block_index, block_index // 6 AS g, regexp_extract(selector_map, '([a-z0-9]+)(?::nth-child\\(\\d+\\))?$', 1) AS tag FROM b WHERE processor_type = 'snapshot'),
    sp AS (SELECT t.*, sb.g, sb.tag AS block_tag, 'span' AS tag FROM t JOIN sb USING (sdt_id, block_index) WHERE sb.tag <> '' AND stream_offset IS NOT NULL AND text <> ''),
    {_level('l0', "SELECT DISTINCT sdt_id, g, 'section' AS tag FROM sp", 'sdt_id', 'g')},
    {_level('l1', "SELECT DISTINCT sdt_id, g, block_index, block_tag AS tag FROM sp", 'sdt_id, g', 'block_index')},
    {_level('l2', "SELECT * FROM sp", 'sdt_id, block_index', 'ref')},
    e0 AS (SELECT sdt_id, g, g * 100000 AS node_no, CASE WHEN g % 2 = 0 THEN '#s' || g ELSE 'body > section' || {_PSEUDO} END AS selector,
                  CASE WHEN lag(g) OVER (PARTITION BY sdt_id ORDER BY g) % 2 = 0 THEN '#s' || lag(g) OVER (PARTITION BY sdt_id ORDER BY g) || ' + section' END AS after FROM l0),
    e1 AS (SELECT l1.sdt_id, block_index, e0.node_no + 1 + (block_index - 6 * l1.g) * 10000 AS node_no, e0.selector || ' > ' || tag || {_PSEUDO} AS selector FROM l1 JOIN e0 USING (sdt_id, g)),
    e2 AS (SELECT l2.sdt_id, node_id, e1.node_no + 1 + i AS node_no, e1.selector || ' > span' || {_PSEUDO} AS selector FROM l2 JOIN e1 USING (sdt_id, block_index)),
    every AS (SELECT sdt_id, node_no, selector FROM e0 UNION ALL SELECT sdt_id, node_no, selector FROM e1 UNION ALL SELECT sdt_id, node_no, selector FROM e2)
"""
_ISLANDS = """
    w AS (SELECT *, ref[:len(ref)-1] AS parent, ref[len(ref)] AS o FROM t {where}),
    k AS (SELECT *, CASE WHEN lag(o) OVER p = o - 1 AND lag(style) OVER p IS NOT DISTINCT FROM style THEN NULL ELSE o END AS opens FROM w WINDOW p AS (PARTITION BY sdt_id, parent ORDER BY o)),
    g AS (SELECT *, max(opens) OVER (PARTITION BY sdt_id, parent ORDER BY o) AS first_ordinal FROM k)
"""

ORACLE = {
    "node_lookups": f"""
        WITH {_BLOCKS}, {_TEXTS}, {_REFS}, o AS (SELECT DISTINCT sdt_id, ord, ref FROM outline WHERE ref IS NOT NULL),
        a AS (SELECT sdt_id, ord, 'own' AS what, ref FROM o UNION ALL SELECT sdt_id, ord, 'below', list_append(ref, 0) FROM o UNION ALL SELECT sdt_id, ord, 'beyond', list_append(ref, 99999) FROM o)
        SELECT a.sdt_id, ord, what, CASE WHEN t.ref IS NOT NULL THEN 'text' WHEN refs.ref IS NOT NULL THEN 'block' END AS kind, b.block_type FROM a
        LEFT JOIN t ON t.sdt_id = a.sdt_id AND t.ref = a.ref LEFT JOIN refs ON refs.sdt_id = a.sdt_id AND refs.ref = a.ref LEFT JOIN b ON b.sdt_id = a.sdt_id AND [b.block_index] = a.ref
    """,
    "range_edges": f"""
        WITH {_PAGES} SELECT sdt_id, page_index, array_to_string(range_start, ',') AS own_start, array_to_string(range_end, ',') || ',7' AS own_end,
            array_to_string(range_end, ',') || ',3' AS "start", array_to_string(range_start, ',') AS "end" FROM p WHERE range_start IS NOT NULL AND range_end IS NOT NULL
    """,
    "cursor_steps": f"""
        WITH {_BLOCKS}, {_TEXTS}, {_REFS}, x AS (SELECT sdt_id, ref, 'end' AS what, CASE WHEN text <> '' THEN ref END AS hit FROM t UNION ALL SELECT sdt_id, ref, 'block', NULL FROM refs),
        y AS (SELECT sdt_id, what || ' ' || array_to_string(ref, ',') AS cursor_id, min(hit) OVER (PARTITION BY sdt_id ORDER BY ref ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n,
                     min(hit) OVER (PARTITION BY sdt_id, ref[1] ORDER BY ref ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS c FROM x)
        SELECT sdt_id, cursor_id, array_to_string(n, ',') AS next_ref, CASE WHEN n IS NULL THEN 0 ELSE 1 END AS next_offset, array_to_string(c, ',') AS next_in_block FROM y
    """,
    "delta_composed": f"""
        WITH {_MAPPED}, q AS (SELECT node_id, f, unnest(range(0, n + 1, 7)) AS position FROM m), r AS (SELECT *, position - {_DELTA.format(map='f', at='position')} AS mid FROM q)
        SELECT node_id, position, mid - {_DELTA.format(map='f', at='mid')} AS source_position FROM r
    """,
    "delta_merged": f"""
        WITH {_MAPPED}, z AS (SELECT *, lead(f) OVER w AS f2, lead(n) OVER w AS n2 FROM m WINDOW w AS (PARTITION BY sdt_id, block_index ORDER BY ref, node_id)),
        q AS (SELECT node_id, f, f2, n, unnest(range(0, n + n2 + 1, 7)) AS position FROM z WHERE f2 IS NOT NULL)
        SELECT node_id, position, position - CASE WHEN position < n THEN {_DELTA.format(map='f', at='position')} ELSE f[len(f)].d + {_DELTA.format(map='f2', at='position - n')} END AS source_position FROM q
    """,
    "cfi_spans": f"""
        WITH {_BLOCKS}, {_TEXTS}, u AS (SELECT t.sdt_id, t.block_index, b.selector_map, {_units('t.text')} AS n, row_number() OVER w AS k, sum({_units('t.text')}) OVER w AS e, sum({_units('t.text')}) OVER (PARTITION BY t.sdt_id, t.block_index) AS whole,
                count(*) OVER (PARTITION BY t.sdt_id, t.block_index) AS texts FROM t JOIN b USING (sdt_id, block_index)
                WHERE t.text <> '' AND b.processor_type = 'epub' AND b.selector_map LIKE '/%' WINDOW w AS (PARTITION BY t.sdt_id, t.block_index ORDER BY t.ref)),
        a AS (SELECT *, 1 - (e - n) AS la FROM u WHERE texts > 1 AND whole > 3 AND e - n <= 1 AND e > 1), z AS (SELECT *, whole - 2 - (e - n) + 1 AS lz FROM u WHERE texts > 1 AND whole > 3 AND e - n <= whole - 2 AND e > whole - 2)
        SELECT a.sdt_id, a.block_index, 'epubcfi(' || a.selector_map || CASE WHEN a.k = z.k AND lz = la + 1 THEN '/' || (2 * a.k - 1) || ':' || la WHEN a.k = z.k THEN '/' || (2 * a.k - 1) || ',:' || la || ',:' || lz
            ELSE ',/' || (2 * a.k - 1) || ':' || la || ',/' || (2 * z.k - 1) || ':' || lz END || ')' AS fragment FROM a JOIN z USING (sdt_id, block_index)
    """,
    "merged_selector_maps": f"""
        WITH {_BLOCKS}, {_TEXTS}, {_ISLANDS.format(where="SEMI JOIN (SELECT * FROM b WHERE processor_type = 'epub') e USING (sdt_id, block_index)")}
        SELECT sdt_id, array_to_string(parent, ',') AS parent_ref, first_ordinal, count(*) AS count, CASE WHEN count(*) = 1 THEN any_value('/4/' || block_index || '/' || (2 * o + 1))
            ELSE string_agg({_units('text')} || ' /4/' || block_index || '/' || (2 * o + 1), chr(10) ORDER BY o) END AS selector_map FROM g GROUP BY sdt_id, parent, first_ordinal
    """,
    "glyph_units": f"""
        WITH {_TEXTS}, i AS (SELECT sdt_id, block_index, {_INK} AS n FROM t)
        SELECT sdt_id, block_index, CAST(sum(n) AS BIGINT) AS glyphs, max(n) * 5.0::DOUBLE AS last, sum(5.0::DOUBLE * n * (n - 1) / 2) AS beginnings, block_index AS page_index FROM i WHERE n > 0 GROUP BY ALL
    """,
    "run_compaction": f"""
        WITH {_TEXTS} SELECT sdt_id, count(*) AS runs, CAST(sum(greatest({_INK}, 1)) AS BIGINT) AS characters, true AS within FROM t GROUP BY ALL
    """,
    "merged_runs": f"""
        WITH {_TEXTS}, {_ISLANDS.format(where="")} SELECT sdt_id, array_to_string(parent, ',') AS parent_ref, first_ordinal, count(*) AS count, CAST(count(*) AS INT) AS runs FROM g GROUP BY sdt_id, parent, first_ordinal
    """,
    "soft_part_texts": f"""
        WITH {_BLOCKS}, {_TEXTS}, {_LINKS}, {_SEAM.replace("CASE WHEN regexp_matches(x.last_text", "CASE WHEN l.block_index % 2 = 0 THEN '' WHEN regexp_matches(x.last_text", 1)},
        m AS (SELECT DISTINCT sdt_id, block_index FROM (SELECT * FROM l UNION ALL SELECT sdt_id, block_index + 1 FROM l)),
        i AS (SELECT m.sdt_id, m.block_index, b.text, s.sep, n.cut,
                     max(CASE WHEN l.block_index IS NULL THEN m.block_index END) OVER (PARTITION BY m.sdt_id ORDER BY m.block_index) AS root
              FROM m JOIN b USING (sdt_id, block_index) LEFT JOIN l ON l.sdt_id = m.sdt_id AND l.block_index = m.block_index - 1
              LEFT JOIN seam s ON s.sdt_id = m.sdt_id AND s.block_index = m.block_index LEFT JOIN seam n ON n.sdt_id = m.sdt_id AND n.block_index = m.block_index + 1)
        SELECT sdt_id, root, count(*) AS parts, string_agg(CASE WHEN block_index = root THEN '' ELSE coalesce(sep, '') END || CASE WHEN cut AND suffix(text, '-') THEN text[:-2] ELSE text END, '' ORDER BY block_index) AS text
        FROM i GROUP BY sdt_id, root
    """,
    "encoded_names": "SELECT p_partkey, p_name AS text, CAST(length(replace(p_name, ' ', '')) AS INT) AS glyphs FROM part",
    "section_selectors": f"WITH {_BLOCKS}, {_TEXTS}, {_SECTIONS} SELECT * FROM every",
    "section_matches": f"WITH {_BLOCKS}, {_TEXTS}, {_SECTIONS} SELECT sdt_id, selector, node_no FROM every UNION ALL SELECT sdt_id, after, node_no FROM e0 WHERE after IS NOT NULL",
    "section_holders": f"""
        WITH {_BLOCKS}, {_TEXTS}, {_SECTIONS}, q AS (SELECT DISTINCT node_id, sdt_id, stream_offset AS a, stream_offset + {_units('text')} AS z FROM t WHERE stream_offset IS NOT NULL AND text <> ''),
        r2 AS (SELECT sdt_id, g, block_index, i, stream_offset AS a, stream_offset + {_units('text')} AS z FROM l2),
        r1 AS (SELECT sdt_id, g, block_index, min(a) AS a, max(z) AS z FROM r2 GROUP BY ALL), r0 AS (SELECT sdt_id, g, min(a) AS a, max(z) AS z FROM r2 GROUP BY ALL),
        h0 AS (SELECT node_id, q.sdt_id, q.a, q.z, min(g) AS g FROM q JOIN r0 ON r0.sdt_id = q.sdt_id AND r0.a <= q.a AND q.z <= r0.z GROUP BY ALL),
        h1 AS (SELECT h0.*, min(block_index) AS block_index FROM h0 JOIN r1 ON r1.sdt_id = h0.sdt_id AND r1.g = h0.g AND r1.a <= h0.a AND h0.z <= r1.z GROUP BY ALL),
        h2 AS (SELECT h1.node_id, min(i) AS i FROM h1 JOIN r2 ON r2.sdt_id = h1.sdt_id AND r2.block_index = h1.block_index AND r2.a <= h1.a AND h1.z <= r2.z GROUP BY ALL)
        SELECT q.node_id, h0.g * 100000 + coalesce(1 + (h1.block_index - 6 * h0.g) * 10000, 0) + coalesce(1 + i, 0) AS node_no FROM q LEFT JOIN h0 USING (node_id) LEFT JOIN h1 USING (node_id) LEFT JOIN h2 USING (node_id)
    """,
    "pack_ranges": f"""
        WITH {_BLOCKS}, {_TEXTS}, i AS (SELECT sdt_id, block_type, row_number() OVER (PARTITION BY sdt_id ORDER BY block_index) - 1 AS block_index FROM b SEMI JOIN t USING (sdt_id, block_index))
        SELECT sdt_id, block_index, block_type FROM i WHERE block_index BETWEEN 2 AND 5
    """,
    "pack_metadata": f"WITH {_BLOCKS}, {_TEXTS} SELECT sdt_id, '1.2.0' AS schema_version, CAST(count(*) AS INT) AS block_count, 'pdf' AS processor_type FROM b SEMI JOIN t USING (sdt_id, block_index) GROUP BY sdt_id",
    "edited_trees": f"""
        WITH {_TEXTS}, u AS (SELECT sdt_id, block_index, {_units('text')} AS n, row_number() OVER (PARTITION BY sdt_id, block_index ORDER BY ref) - 1 AS i, count(*) OVER (PARTITION BY sdt_id, block_index) AS texts,
                                    dense_rank() OVER (PARTITION BY sdt_id ORDER BY block_index) - 1 AS place FROM t),
        s AS (SELECT sdt_id, place, i AS ordinal, n AS units, texts > 1 AND i = 1 AND n > 0 AS bold FROM u WHERE texts > 1 OR n < 3
              UNION ALL SELECT sdt_id, place, unnest([0, 1, 2]), unnest([1, n - 2, 1]), unnest([false, true, false]) FROM u WHERE texts = 1 AND n >= 3)
        SELECT sdt_id, CAST(place AS INT) AS place, CAST(ordinal AS INT) AS ordinal, CAST(units AS INT) AS units, bold FROM s
    """,
    "selected_slices": f"""
        WITH {_BLOCKS}, {_TEXTS}, f AS (SELECT sdt_id, block_index, ref[:len(ref)-1] AS ref, arg_min(text, ref) AS text FROM t GROUP BY ALL)
        SELECT f.sdt_id, array_to_string(f.ref, ',') AS ref, f.text FROM f JOIN b USING (sdt_id, block_index) WHERE coalesce(flow_class, '') <> 'excluded'
    """,
    "sentence_cover": f"""
        WITH {_BLOCKS}, {_TEXTS}, {_LEAVES}, c AS (SELECT leaf.sdt_id, array_to_string(ref, ',') AS ref, regexp_replace(leaf.text, '[{_JS_BLANKS}]+', '', 'g') AS letters FROM leaf JOIN b USING (sdt_id, block_index)
                                                   WHERE coalesce(flow_class, '') <> 'excluded')
        SELECT * FROM c WHERE letters <> ''
    """,
    "sentence_boxes": f"""
        WITH {_TEXTS}, i AS (SELECT sdt_id, block_index, ref[:len(ref)-1] AS leaf, min(text) AS text, count(*) AS n FROM t GROUP BY ALL)
        SELECT sdt_id, array_to_string(leaf, ',') AS ref, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS INT) AS rects, block_index AS page_index,
               5.0::DOUBLE * length(regexp_extract(text, '[A-Za-z0-9]+')) AS "right" FROM i
        WHERE n = 1 AND regexp_matches(text, '^[A-Za-z0-9 ]*[A-Za-z0-9][A-Za-z0-9 ]*$')
    """,
    "rect_leaves": f"""
        WITH {_BLOCKS}, {_TEXTS}, {_PAGES}, {_LEAVES}, top AS (SELECT sdt_id, page_index, min(block_index) AS k FROM b WHERE page_index IS NOT NULL GROUP BY ALL)
        SELECT DISTINCT leaf.sdt_id, top.page_index, array_to_string(leaf.ref, ',') AS ref FROM leaf JOIN b USING (sdt_id, block_index) JOIN top ON top.sdt_id = b.sdt_id AND top.page_index = b.page_index
        JOIN p ON p.sdt_id = b.sdt_id AND p.page_index = b.page_index
        WHERE leaf.block_index BETWEEN k AND k + 2 AND list_append(leaf.ref[:len(leaf.ref)-1], leaf.ref[len(leaf.ref)] + 1) > range_start AND leaf.ref < range_end
    """,
    "chunk_rects": f"""
        WITH {_BLOCKS}, c AS (SELECT DISTINCT sdt_id, start_block_index, end_block_index FROM chunks)
        SELECT c.sdt_id, start_block_index, CAST(count(*) AS INT) AS rects, string_agg(DISTINCT page_index::VARCHAR, ',' ORDER BY page_index::VARCHAR) AS pages FROM c
        JOIN b ON b.sdt_id = c.sdt_id AND block_index BETWEEN start_block_index AND end_block_index WHERE page_index IS NOT NULL AND coalesce(flow_class, '') <> 'excluded' GROUP BY ALL
    """,
    "outline_json": f"WITH {_ENTRIES} SELECT sdt_id, CAST(count(*) FILTER (depth = 0) AS INT) AS roots, CAST(count(*) AS INT) AS entries FROM e WHERE title <> '' GROUP BY ALL",
}
