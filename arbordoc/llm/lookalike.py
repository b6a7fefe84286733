"""Problem 2: one form for all texts that look the same.

The skeleton of a text (see :mod:`skeleton`) is its comparison key.  ASCII texts are their own skeleton
and stay inside the JVM; only the others cross to Python, in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import cut
from ..functions import deltamap
from ..functions.utf16 import py_len
from . import skeleton as sk


@F.pandas_udf(T.StringType())
def _skeleton_udf(text: pd.Series) -> pd.Series:
    return text.map(sk.skeleton, na_action="ignore")


@F.pandas_udf(T.StructType().add("text", T.StringType()).add("delta_map", T.StringType()))
def _unify_udf(text: pd.Series, delta_map: pd.Series) -> pd.DataFrame:
    rows = []
    for t, d in zip(text, delta_map):
        if t is None:
            rows.append((None, None))
            continue
        form, back = sk.unify(t)
        rows.append((form, deltamap.compose(back, d, py_len(form)) or None))
    return pd.DataFrame(rows, columns=["text", "delta_map"])


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def skeleton_of(text: Column) -> Column:
    """The comparison key of a text column; NULL for NULL."""
    return F.coalesce(_skeleton_udf(F.when(~_ascii(text), text)), F.trim(text))


def unify_texts(nodes: DataFrame, text: str = "text", delta_map: str = "delta_map") -> DataFrame:
    """All rows of ``nodes``, with two columns more and no shuffle.

    ``unified_text`` is the one form of the text, ``unified_delta_map`` leads from its positions back to
    the source that ``delta_map`` leads to (an absent map counts as one to one).  A NULL text stays NULL
    with a NULL map; an empty one stays empty.  Rows are kept as they are, repeated ones too.
    """
    sk.ship(nodes.sparkSession)
    plain = _ascii(F.col(text)) & (F.trim(text) == F.col(text))
    both = _unify_udf(F.when(~plain, F.col(text)), F.when(~plain, F.col(delta_map)))
    return (
        nodes.withColumn("_unified", both)
        .withColumn("unified_text", F.coalesce(F.col("_unified.text"), F.col(text)))
        .withColumn("unified_delta_map", F.when(plain, F.nullif(F.col(delta_map), F.lit(""))).otherwise(F.col("_unified.delta_map")))
        .drop("_unified")
    )


def keyed_nodes(nodes: DataFrame, node: str, scope: str, text: str) -> DataFrame:
    """(node, scope, look, form): 128-bit digests of the skeleton and of the text without outer blanks."""
    return nodes.where(F.col(text).isNotNull() & F.col(scope).isNotNull() & F.col(node).isNotNull()).select(
        F.col(node).alias("node"),
        F.col(scope).alias("scope"),
        F.unhex(F.md5(skeleton_of(F.col(text)))).alias("look"),
        F.unhex(F.md5(F.trim(text))).alias("form"),
    )


def lookalike_nodes(nodes: DataFrame, node: str = "node_id", scope: str = "sdt_id", text: str = "text") -> DataFrame:
    """The nodes whose text has, within its scope, a look-alike of other characters: (scope, look, form, node), distinct.

    ``look`` is the class of equal skeletons, ``form`` the spelling.  Classes of one spelling, however
    many rows they have, are dropped by a pre-aggregated minimum and maximum, before anything is joined.
    NULL nodes, scopes and texts have no look-alike.
    """
    sk.ship(nodes.sparkSession)
    keyed = cut(keyed_nodes(nodes, node, scope, text))
    mixed = (
        keyed.groupBy("scope", "look")
        .agg(F.min("form").alias("least"), F.max("form").alias("greatest"))
        .where("least <> greatest")
        .select("scope", "look")
    )
    return keyed.join(mixed, ["scope", "look"], "left_semi").distinct()


def lookalike_classes(nodes: DataFrame, node: str = "node_id", scope: str = "sdt_id", text: str = "text") -> DataFrame:
    """(scope, node, class, spelling, links): one row per node that has look-alikes.

    ``class`` names the texts of a scope that look the same, ``spelling`` those of the same characters;
    ``links`` counts the nodes of the class in other spellings.  Linear in the nodes: no pairs are made.  A
    node whose repeated rows have several spellings has a row for each.
    """
    members = cut(lookalike_nodes(nodes, node, scope, text))
    spelled = members.groupBy("scope", "look", "form").agg(F.count("*").alias("n"))
    whole = spelled.groupBy("scope", "look").agg(F.sum("n").alias("all"))
    counted = spelled.join(whole, ["scope", "look"]).select("scope", "look", "form", (F.col("all") - F.col("n")).alias("links"))
    return members.join(counted, ["scope", "look", "form"]).select(
        "scope", "node", F.lower(F.hex("look")).alias("class"), F.lower(F.hex("form")).alias("spelling"), "links"
    )


def lookalike_spellings(nodes: DataFrame, node: str = "node_id", scope: str = "sdt_id", text: str = "text") -> DataFrame:
    """(scope, class, spelling_a, spelling_b, node_a, node_b, nodes_a, nodes_b): pairs of spellings, each by its least node and its number of nodes."""
    members = lookalike_nodes(nodes, node, scope, text)
    spelled = cut(members.groupBy("scope", "look", "form").agg(F.min("node").alias("node"), F.count("*").alias("nodes")))
    a, b = (spelled.select("scope", "look", *(F.col(c).alias(f"{c}_{side}") for c in ("form", "node", "nodes"))) for side in "ab")
    return a.join(b, ["scope", "look"]).where("form_a < form_b").select(
        "scope", F.lower(F.hex("look")).alias("class"), F.lower(F.hex("form_a")).alias("spelling_a"), F.lower(F.hex("form_b")).alias("spelling_b"), "node_a", "node_b", "nodes_a", "nodes_b"
    )


def lookalike_pairs(nodes: DataFrame, node: str = "node_id", scope: str = "sdt_id", text: str = "text") -> DataFrame:
    """(node_a, node_b), a < b: nodes of one scope whose texts look the same but are not the same characters.

    Spellings of a class are paired first and then replaced by their nodes, so that every row that is
    joined is a row of the result: copies of one spelling never meet each other.  Where that many rows are
    not wanted, :func:`lookalike_classes` says the same by class and :func:`lookalike_spellings` by spelling.
    """
    members = lookalike_nodes(nodes, node, scope, text)
    forms = members.select("scope", "look", "form").distinct()
    other = forms.select("scope", "look", F.col("form").alias("form_b"))
    spelled = forms.join(other, ["scope", "look"]).where("form < form_b")
    a = members.withColumnRenamed("node", "a")
    b = members.select("scope", "look", F.col("form").alias("form_b"), F.col("node").alias("b"))
    pairs = spelled.join(a, ["scope", "look", "form"]).join(b, ["scope", "look", "form_b"])
    return pairs.where("a <> b").select(F.least("a", "b").alias("node_a"), F.greatest("a", "b").alias("node_b")).distinct()
