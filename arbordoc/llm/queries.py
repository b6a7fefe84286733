"""The queries of the training-data problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import table
from .boilerplate import main_body
from .lookalike import lookalike_classes, lookalike_pairs, unify_texts
from .mixing import mixture, share_report
from .oracle import ORACLE  # noqa: F401
from .packing import fill_report, pack
from .repetition import repetition, repetitive_documents
from .scanned import page_windows, paragraphs, scan_findings
from .split import split_chunks, split_oversized


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks over their size limit: those the splitter cuts."""
    pieces = split_oversized(table(spark, folder, "chunks"), table(spark, folder, "size_limits"))
    return pieces.where("piece_index = 0").select("chunk_id")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every oversized chunk, with the blocks it covers."""
    return split_chunks(table(spark, folder, "chunks"), table(spark, folder, "size_limits"), table(spark, folder, "blocks"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of nodes of a tree whose texts look the same but differ in their characters."""
    pairs = lookalike_pairs(table(spark, folder, "text_nodes"))
    return pairs.select(F.col("node_a").alias("node_id_a"), F.col("node_b").alias("node_id_b"))


def p2_unified(spark: SparkSession, folder: str) -> DataFrame:
    """All text nodes in their one form, with the map back to the source."""
    nodes = table(spark, folder, "text_nodes").select("node_id", "sdt_id", "text", "delta_map").distinct()
    return unify_texts(nodes).select("node_id", "sdt_id", "unified_text", "unified_delta_map")


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    """All text nodes in their one form."""
    return p2_unified(spark, folder).where("unified_text IS NOT NULL").select("node_id", "sdt_id", "unified_text").distinct()


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes that have look-alikes in their tree, with how many."""
    told = lookalike_classes(table(spark, folder, "text_nodes"))
    return told.select(F.col("scope").alias("sdt_id"), F.col("node").alias("node_id"), "links")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of web pages that are not main body."""
    return main_body(table(spark, folder, "blocks")).where("NOT main_body").select("sdt_id", "block_index")


def p3_main_body(spark: SparkSession, folder: str) -> DataFrame:
    """The main body of every web page, block by block."""
    blocks = table(spark, folder, "blocks")
    keep = main_body(blocks).where("main_body").select("sdt_id", "block_index")
    return blocks.select("sdt_id", "block_index", "block_type", "text").distinct().join(keep, ["sdt_id", "block_index"])


def p3_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """How many blocks of every web page are judged."""
    return main_body(table(spark, folder, "blocks")).groupBy("sdt_id").agg(F.count("*").alias("blocks"), F.countDistinct("block_index").alias("distinct_blocks"))


def p4_lines(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines of every scanned page are classified, and how many of them are blank."""
    scanned = table(spark, folder, "page_info").where("text_source = 'ocr'").select("sdt_id", "page_index", "text")
    lines = page_windows(scanned).select("sdt_id", F.explode(F.arrays_zip("page", "line", "kind")).alias("l")).select("sdt_id", "l.*")
    return lines.groupBy("sdt_id", F.col("page").alias("page_index")).agg(F.count("*").alias("lines"), F.max("line").alias("last_line"), F.count_if(F.col("kind") == "blank").alias("blank_lines"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of scanned pages that are furniture, end in a parted word, or have a misread word."""
    return scan_findings(table(spark, folder, "page_info"))


def p4_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Scanned trees as continuous paragraphs."""
    return paragraphs(table(spark, folder, "page_info"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """All posts in containers of each capacity."""
    return pack(table(spark, folder, "documents"), table(spark, folder, "capacities"))


def p1_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Per oversized chunk what its pieces add up to: units from first to last, pieces over the limit, and seams that overlap otherwise than asked."""
    chunks, limits = table(spark, folder, "chunks"), table(spark, folder, "size_limits")
    kinds = chunks.select("chunk_id", "processor_type").distinct()
    pieces = split_oversized(chunks, limits).join(kinds, "chunk_id").join(limits, "processor_type")
    order = Window.partitionBy("chunk_id").orderBy("piece_index")
    shared = F.lag("end_unit").over(order) - F.col("start_unit")
    # one unit more where the overlap would part a pair of surrogates
    told = pieces.withColumn("bad", ~shared.between(F.col("overlap_units"), F.col("overlap_units") + 1)).withColumn("over", F.col("end_unit") - F.col("start_unit") > F.col("max_units"))
    return told.groupBy("chunk_id").agg(
        (F.max("end_unit") - F.min("start_unit")).cast("bigint").alias("units"), F.count_if("over").alias("pieces_over"), F.count_if("bad").alias("seams_off")
    )


def p6_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per capacity: posts that have a place, posts with more or fewer places than pieces, and containers that hold too much."""
    capacities = table(spark, folder, "capacities")
    placed = pack(table(spark, folder, "documents"), capacities).join(capacities, "capacity_name")
    posts = placed.groupBy("capacity_name", "doc_id", "capacity_tokens").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.countDistinct("piece").alias("distinct"))
    wrong = (F.col("pieces") != F.ceil(F.col("tokens") / F.col("capacity_tokens"))) | (F.col("pieces") != F.col("distinct"))
    full = placed.groupBy("capacity_name", "container_id").agg((F.sum("tokens") > F.max("capacity_tokens")).alias("over")).groupBy("capacity_name").agg(F.count_if("over").alias("containers_over"))
    per = posts.groupBy("capacity_name").agg(F.count("*").alias("posts"), F.count_if(wrong).alias("posts_wrong"))
    return per.join(full, "capacity_name")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How well the containers are filled."""
    capacities = table(spark, folder, "capacities")
    return fill_report(pack(table(spark, folder, "documents"), capacities), capacities)


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture of boards, in order."""
    return mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per board with a target: whether a post is used too often or twice at once, and whether it is of another board."""
    targets = table(spark, folder, "mix_targets")
    posts = table(spark, folder, "documents").select("doc_id", F.lower(F.trim("source")).alias("of")).distinct()
    used = mixture(table(spark, folder, "documents"), targets).groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.countDistinct("use").alias("distinct"))
    told = used.join(posts, "doc_id").join(targets.select("source", "max_repeats"), "source")
    return told.groupBy("source").agg(
        F.count_if((F.col("uses") > F.col("max_repeats")) | (F.col("uses") != F.col("distinct"))).alias("posts_too_often"), F.count_if(F.col("of") != F.col("source")).alias("posts_of_others")
    )


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the mixture reaches."""
    targets = table(spark, folder, "mix_targets")
    return share_report(mixture(table(spark, folder, "documents"), targets), targets)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of which at least a third repeats earlier content."""
    return repetitive_documents(table(spark, folder, "documents")).select("doc_id")


def p8_share(spark: SparkSession, folder: str) -> DataFrame:
    """The repeated share of every post."""
    posts = table(spark, folder, "documents").select("doc_id", "text").distinct()
    return repetition(posts).select("doc_id", "repeated", "total", "repeated_share")


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p1_cover": p1_cover,
    "p2_unified": p2_unified,
    "p2_forms": p2_forms,
    "p2_classes": p2_classes,
    "p3_found": p3_found,
    "p3_main_body": p3_main_body,
    "p3_blocks": p3_blocks,
    "p4_lines": p4_lines,
    "p4_found": p4_found,
    "p4_paragraphs": p4_paragraphs,
    "p6_containers": p6_containers,
    "p6_check": p6_check,
    "p6_fill": p6_fill,
    "p7_mixture": p7_mixture,
    "p7_check": p7_check,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_share": p8_share,
}
