"""Section chunks: the text between outline entries, set-wise over a corpus.

The entries' block indexes cut a document in regions.  Of each region the chunk runs from its first block
that is not excluded to its last that is neither excluded nor blank; an entry's own block gives no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import cut
from ..functions.utf16 import u16_len
from .carry import carry_forward

#: UTF-16 units that a chunk's text has at least.
LEAST_UNITS = 30


def section_chunks(blocks: DataFrame, outline: DataFrame, key: str = "doc_id", least_units: int = LEAST_UNITS) -> DataFrame:
    """(key, start_block_index, end_block_index, leaf_block_count, outline_path, text, page_rects).

    ``blocks`` has the top-level blocks: key, block_index, text (nested plain text), flow_class,
    leaf_block_count and page_rects (ARRAY<ARRAY<DOUBLE>>, may be missing as a column).  ``outline`` has key,
    ord (preorder), block_index (NULL if an entry has no place) and outline_path.  Rows with a NULL key or
    index are left out, repeated rows count once.  Entries of one block: the last in preorder names the
    path.  Page rectangles that are no five numbers are dropped; the others are ordered by page, those of
    a page in document order.
    """
    return _gathered(_regions(blocks, _places(blocks, outline, key), key), [key], least_units).drop("region_index")


def _places(blocks: DataFrame, outline: DataFrame, key: str) -> DataFrame:
    """(key, block_index, head, region_index, outline_path): a block's region is its first entry's block, -1 before the first entry."""
    rows = blocks.where(F.col(key).isNotNull() & F.col("block_index").isNotNull()).select(key, "block_index").distinct()
    entries = (
        outline.where("block_index >= 0")
        .groupBy(key, "block_index")
        .agg(F.max_by("outline_path", "ord").alias("entry_path"))
        .withColumn("opens", F.lit(True))
    )
    marked = rows.join(entries, [key, "block_index"], "left")
    region = carry_forward(
        marked, key, "block_index",
        F.when(F.col("opens"), F.struct("block_index", F.coalesce("entry_path", F.lit("")).alias("path"))), "region",
    )
    return region.select(
        key, "block_index", F.coalesce("opens", F.lit(False)).alias("head"),
        F.coalesce("region.block_index", F.lit(-1)).alias("region_index"), F.coalesce("region.path", F.lit("")).alias("outline_path"),
    )


def _regions(blocks: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """The blocks with their region; texts take no part in finding it."""
    has_rects = "page_rects" in blocks.columns
    rects = F.col("page_rects") if has_rects else F.lit(None).cast("array<array<double>>")
    rows = (
        blocks.where(F.col(key).isNotNull() & F.col("block_index").isNotNull())
        .select(key, "block_index", F.struct("text", "flow_class", "leaf_block_count", rects.alias("page_rects")).alias("row"))
        .groupBy(key, "block_index")
        .agg(F.max("row").alias("row"))
        .select(key, "block_index", "row.*")
    )
    return rows.join(places, [key, "block_index"])


def _gathered(region: DataFrame, by: list[str], least_units: int) -> DataFrame:
    """The chunk of each region and ``by``, if it is long enough."""
    kept = region.where(F.coalesce(F.col("flow_class"), F.lit("")) != "excluded")
    filled = F.coalesce(F.col("text"), F.lit("")) != ""
    gathered = (
        kept.groupBy(*by, "region_index", "outline_path")
        .agg(
            F.min("block_index").alias("start_block_index"),
            F.max(F.when(filled, F.col("block_index"))).alias("last_filled"),
            F.array_sort(F.collect_list(F.struct("block_index", "head", "text", "leaf_block_count", "page_rects"))).alias("parts"),
        )
        .withColumn("end_block_index", F.greatest("start_block_index", F.coalesce("last_filled", F.lit(-1))))
    )
    inside = F.filter("parts", lambda p: p.block_index <= F.col("end_block_index"))
    told = gathered.withColumn("parts", inside)
    texts = F.filter(F.transform(F.filter("parts", lambda p: ~p["head"]), lambda p: p.text), lambda t: F.coalesce(t, F.lit("")) != "")
    leaves = F.aggregate(F.filter("parts", lambda p: ~p["head"]), F.lit(0).cast("bigint"), lambda n, p: n + F.coalesce(p.leaf_block_count, F.lit(0)))
    flat = F.flatten(F.transform("parts", lambda p: F.coalesce(p.page_rects, F.array().cast("array<array<double>>"))))
    good = F.filter(flat, lambda r: (F.size(r) >= 5) & F.get(r, F.lit(0)).isNotNull() & ~F.isnan(F.get(r, F.lit(0))))
    placed = F.transform(good, lambda r, k: F.struct(F.get(r, F.lit(0)).alias("page"), k.alias("k"), F.slice(r, 1, 5).alias("r")))
    out = told.select(
        *by, "region_index", "start_block_index", "end_block_index", leaves.cast("int").alias("leaf_block_count"), "outline_path",
        F.array_join(texts, "\n").alias("text"), F.transform(F.array_sort(placed), lambda x: x.r).alias("page_rects"),
    )
    return out.where(u16_len(F.col("text")) >= least_units)


def next_chunk(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first chunk of every document."""
    first = F.min_by(F.struct(*(c for c in chunks.columns if c != key)), "start_block_index")
    return chunks.groupBy(key).agg(first.alias("c")).select(key, "c.*")


def next_chunk_from(blocks: DataFrame, outline: DataFrame, requests: DataFrame, key: str = "doc_id", least_units: int = LEAST_UNITS) -> DataFrame:
    """The first chunk at or behind each request (key, from_block_index): both, and the columns of a chunk.

    ``blocks`` and ``outline`` are those of :func:`section_chunks`.  A start inside a region gives the rest of
    it, under the path of the entry before; where that is too short, the next region's chunk follows.
    Requests for no block of the document, and those with no chunk behind them, give no row.
    """
    places = _places(blocks, outline, key)
    regions = _regions(blocks, places, key)
    asked = requests.select(key, F.col("from_block_index").cast("int").alias("from_block_index")).distinct()
    # first by lengths alone which region each request reads, and from where; texts are gathered once
    told = (F.coalesce(F.col("flow_class"), F.lit("")) != "excluded") & ~F.col("head") & (F.coalesce(F.col("text"), F.lit("")) != "")
    sizes = cut(regions.select(key, "block_index", "region_index", F.when(told, u16_len(F.col("text")) + 1).cast("bigint").alias("n")))
    enough = F.coalesce(F.sum("n") - 1, F.lit(0)) >= least_units
    behind = Window.partitionBy(key).orderBy("region_index").rowsBetween(1, Window.unboundedFollowing)
    whole = sizes.groupBy(key, "region_index").agg(enough.alias("enough"))
    follows = whole.select(key, "region_index", F.min(F.when(F.col("enough"), F.col("region_index"))).over(behind).alias("next_region"))
    placed = asked.join(sizes.select(key, F.col("block_index").alias("from_block_index"), "region_index"), [key, "from_block_index"])
    rest = placed.join(sizes, [key, "region_index"]).where("block_index >= from_block_index").groupBy(key, "region_index", "from_block_index")
    target = rest.agg(enough.alias("here")).join(follows, [key, "region_index"])
    read = target.select(
        key, "from_block_index", F.when(F.col("here"), F.col("region_index")).otherwise(F.col("next_region")).alias("region_index"),
        F.when(F.col("here"), F.col("from_block_index")).otherwise(F.col("next_region")).alias("at"),
    )
    spread = read.join(regions, [key, "region_index"]).where("block_index >= at")
    return _gathered(spread, [key, "from_block_index"], least_units).drop("region_index")
