"""Outlines: paths of titles, and export as nested entries."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


#: Depths whose last entries are carried by one window each; outlines that go deeper are read entry by entry.
WINDOW_DEPTHS = 9


def paths_from_levels(outline: DataFrame, key: str = "doc_id") -> DataFrame:
    """A levelled outline with ``parent_ord``, ``depth`` (0 for roots) and ``title_path``.

    An entry of level L stands at depth L - 1, or one below the entry before it where levels are skipped.
    With i counting a document's entries, that depth is the least of i and of L(j) - 1 + i - j over all
    j <= i, a running minimum; an entry's ancestors are the last entries of each lower depth, and one
    running maximum per depth tells them.  Levels below 1 count as 1.  Repeated rows count once; a NULL
    title is '' in paths.
    """
    rows = outline.where(F.col(key).isNotNull() & F.col("ord").isNotNull()).dropDuplicates([key, "ord"])
    level = F.greatest(F.coalesce("outline_level", F.lit(1)), F.lit(1)).cast("int")
    order = Window.partitionBy(key).orderBy("ord")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_i", F.row_number().over(order) - 1)
    rows = rows.withColumn("depth", F.least(F.col("_i"), F.col("_i") + F.min(level - 1 - F.col("_i")).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    rows = rows.withColumn("_deepest", F.max("depth").over(Window.partitionBy(key)))
    title = F.coalesce("title", F.lit(""))
    here = F.struct("ord", title.alias("title"))
    lower = [F.when(F.col("depth") > n, F.max(F.when(F.col("depth") == n, here)).over(before)) for n in range(WINDOW_DEPTHS)]
    shallow = rows.withColumn("_above", F.array_compact(F.array(*lower)))
    if not outline.where(F.col("outline_level") > WINDOW_DEPTHS + 1).isEmpty():
        deep = rows.where(F.col("_deepest") > WINDOW_DEPTHS).select(key, "ord", "depth", title.alias("title"))
        schema = T.StructType([outline.schema[key], outline.schema["ord"], T.StructField("_stack", T.ArrayType(T.StructType([outline.schema["ord"], T.StructField("title", T.StringType())])))])

        def stacks(key_value: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            told, stack = [], []
            for n, depth, text in sorted(zip(pdf["ord"], pdf["depth"], pdf["title"])):
                del stack[depth:]
                told.append((key_value[0], n, [{"ord": a, "title": t} for a, t in stack]))
                stack.append((n, text))
            return pd.DataFrame(told, columns=schema.names)

        shallow = shallow.join(deep.groupBy(key).applyInPandas(stacks, schema), [key, "ord"], "left").withColumn("_above", F.coalesce("_stack", "_above")).drop("_stack")
    return (
        shallow.withColumn("parent_ord", F.get("_above", F.size("_above") - 1).ord)
        .withColumn("title_path", F.array_append(F.transform("_above", lambda a: a.title), title))
        .drop("_above", "_i", "_deepest")
    )


def outline_path(title_path="title_path"):
    return F.array_join(F.transform(title_path, lambda t: F.coalesce(t, F.lit(""))), " > ")


def exported_entries(outline: DataFrame, key: str = "doc_id") -> DataFrame:
    """The entries that an export has: those with a title whose ancestors all have one, with ``start_ref`` as 'i.j'."""
    start = F.when(F.size("ref") > 0, F.array_join("ref", "."))
    return outline.where("titled").select(key, "ord", "parent_ord", "depth", "title", start.alias("start_ref"), "url", "position", "entry_source")


def export_outline(outline: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, outline): each document's outline as nested JSON, keys in the order title, startRef, url, position, source, children."""

    def nest(key_value: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        made: dict = {}
        roots = []
        for row in pdf.sort_values("ord").itertuples():
            item = {"title": row.title}
            if row.start_ref is not None and row.start_ref == row.start_ref:
                item["startRef"] = row.start_ref
            if isinstance(row.url, str):
                item["url"] = row.url
            if isinstance(row.position, str):
                item["position"] = json.loads(row.position)
            if isinstance(row.entry_source, str):
                item["source"] = row.entry_source
            made[row.ord] = item
            up = None if pd.isna(row.parent_ord) else made.get(int(row.parent_ord))
            (roots if up is None else up.setdefault("children", [])).append(item)
        return pd.DataFrame([(key_value[0], json.dumps(roots, ensure_ascii=False, separators=(",", ":")))], columns=[key, "outline"])

    entries = exported_entries(outline, key)
    return entries.groupBy(key).applyInPandas(nest, T.StructType([outline.schema[key], T.StructField("outline", T.StringType())]))
