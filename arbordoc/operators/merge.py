"""Neighbouring text nodes that differ in nothing but their text become one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import deltamap, glyphs
from ..functions.utf16 import py_len

_ALIKE = ("style", "refs", "back_refs", "target")
_ANCHOR = ("text_map", "selector_map", "stream", "delta_map", "page_rects")


def _islands(nodes: DataFrame, key: str, joins) -> DataFrame:
    """Text nodes with ``island``: the ordinal of the first node each is merged into."""
    order = Window.partitionBy(key, "parent_ref").orderBy("ordinal")
    before = lambda c: F.lag(c).over(order)
    follows = (before("kind") == "text") & (F.col("kind") == "text") & (before("ordinal") + 1 == F.col("ordinal"))
    opens = F.when(F.coalesce(follows & joins(before), F.lit(False)), None).otherwise(F.col("ordinal"))
    return nodes.withColumn("_opens", opens).withColumn("island", F.last("_opens", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("kind = 'text'").drop("_opens")


def _same(before, names):
    out = F.lit(True)
    for c in names:
        out = out & before(c).eqNullSafe(F.col(c))
    return out


def merge_text_nodes(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, parent_ref, first_ordinal, count, text, style, target): runs of text nodes with equal anchors and looks."""
    cols = [c for c in (*_ALIKE, *_ANCHOR) if c in nodes.columns]
    marked = _islands(nodes, key, lambda before: _same(before, cols))
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    kept = [F.min_by(c, "ordinal").alias(c) for c in ("style", "target") if c in nodes.columns]
    return (
        marked.groupBy(key, "parent_ref", F.col("island").alias("first_ordinal"))
        .agg(F.count("*").alias("count"), parts.alias("p"), *kept)
        .withColumn("text", F.array_join(F.transform("p", lambda x: x.text), ""))
        .drop("p")
    )


def merge_runs(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, parent_ref, first_ordinal, count, text, text_map): text nodes of equal looks, with their glyph runs one behind the other.

    Nodes with and without glyph runs do not mix.  Runs are compacted anew only where nodes were merged.
    """
    mixed = lambda before: before("text_map").isNotNull() == F.col("text_map").isNotNull()
    marked = _islands(nodes, key, lambda before: _same(before, _ALIKE) & mixed(before))
    gathered = marked.groupBy(key, "parent_ref", F.col("island").alias("first_ordinal")).agg(
        F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("ordinal", "text", "text_map"))).alias("p")
    )

    @F.pandas_udf(T.StringType())
    def joined(parts: pd.Series) -> pd.Series:
        def one(p):
            if len(p) == 1:
                return p[0]["text_map"]
            runs = [r for x in p for r in glyphs.parse_runs(x["text_map"])]
            return glyphs.dump_runs(runs) if any(x["text_map"] is not None for x in p) else None

        return parts.map(one)

    return gathered.withColumn("text", F.array_join(F.transform("p", lambda x: x.text), "")).withColumn("text_map", joined("p")).drop("p")


def fold_selector_maps(parts: list[tuple[str, str, str | None]], preserve_delta: bool = False) -> tuple[str, str | None]:
    """(selector map, delta map) of merged nodes (text, selector map, delta map).

    Maps of different nodes become entries with lengths.  A new entry starts a fresh anchor, which drops
    the delta map gathered so far; ``preserve_delta`` keeps it.
    """
    text, selector, delta = parts[0]
    length = py_len(text)
    for more, other, other_delta in parts[1:]:
        if selector != other:
            entry = lambda m, n: m if m[:1].isdigit() else f"{n} {m}"
            selector = f"{entry(selector, length)}\n{entry(other, py_len(more))}"
            if not preserve_delta:
                delta = None
        delta = deltamap.merge(delta, other_delta, length) or delta
        length += py_len(more)
    return selector, delta


def merge_selector_maps(nodes: DataFrame, key: str = "doc_id", preserve_delta: bool = False) -> DataFrame:
    """(key, parent_ref, first_ordinal, count, text, selector_map, delta_map): text nodes of equal looks with selector maps."""
    only = lambda col: col("selector_map").isNotNull() & col("stream").isNull() & col("text_map").isNull() & col("page_rects").isNull()
    marked = _islands(nodes, key, lambda before: _same(before, _ALIKE) & only(before) & only(F.col))
    gathered = marked.groupBy(key, "parent_ref", F.col("island").alias("first_ordinal")).agg(
        F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("ordinal", "text", "selector_map", "delta_map"))).alias("p")
    )

    @F.pandas_udf(T.StructType().add("selector_map", T.StringType()).add("delta_map", T.StringType()))
    def joined(parts: pd.Series) -> pd.DataFrame:
        rows = []
        for p in parts:
            if len(p) == 1:
                rows.append((p[0]["selector_map"], p[0]["delta_map"]))
            else:
                rows.append(fold_selector_maps([(x["text"], x["selector_map"], x["delta_map"]) for x in p], preserve_delta))
        return pd.DataFrame(rows, columns=["selector_map", "delta_map"])

    return gathered.withColumn("text", F.array_join(F.transform("p", lambda x: x.text), "")).withColumn("m", joined("p")).select("*", "m.*").drop("p", "m")
