"""Documents as they arrive: packs and JSON trees of a watched folder, flattened into growing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import pack, trees

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_packs(spark: SparkSession, folder: str, files_per_batch: int = 1_000) -> DataFrame:
    """A stream of (doc_id, tree, error, arrived) of the packs that appear in a folder."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).load(folder)
    named = files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "").alias("doc_id"), F.col("content").alias("pack"))
    return pack.unpack_trees(named)


def arriving_trees(spark: SparkSession, folder: str, files_per_batch: int = 1_000) -> DataFrame:
    """A stream of (doc_id, tree) of the JSON files that appear in a folder."""
    files = spark.readStream.schema("value string").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).text(folder)
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), "\\.[^.]*$", "").alias("doc_id"), F.col("value").alias("tree"))


def write_tables(stream: DataFrame, target: str, checkpoint: str, names: tuple[str, ...] = ("documents", "nodes", "pages", "outline")):
    """Appends each batch's tables under ``target``, each row with its ``batch``; returns the query.

    A batch's rows are written to the folder of its number, which a repeated batch overwrites, so a restart
    after a failure neither loses nor doubles rows.
    """

    def one(batch: DataFrame, number: int) -> None:
        good = batch.where("tree IS NOT NULL").persist()
        try:
            for name in names:
                trees.flatten(good, name).write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        finally:
            good.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per time window and key of a stream with late rows; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *by).agg(F.count("*").alias("n"))

