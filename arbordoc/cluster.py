"""What depends on where the session runs: the shared folder, and cutting a plan's lineage there."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master may do without; it gets a
    temporary folder, and any other session without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"arbordoc-{spark.sparkContext.applicationId}")
        os.makedirs(folder, exist_ok=True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder and read from there by every later use."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a scratch path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Gives the session's Python workers this package, wherever they run; once per application."""
    context = spark.sparkContext
    if getattr(context, "_arbordoc_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as out:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(root)))
        aside = tempfile.mkdtemp(prefix="arbordoc-")  # on the driver only; Spark copies it to its own files
        atexit.register(shutil.rmtree, aside, ignore_errors=True)
        path = os.path.join(aside, "arbordoc.zip")
        with open(path, "wb") as file:
            file.write(held.getvalue())
        context.addPyFile(path)
    context._arbordoc_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
