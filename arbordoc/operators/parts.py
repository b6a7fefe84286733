"""Blocks that continue one another: chains of parts, and their text.

Links are followed by pointer doubling: after n rounds every block knows the block 2^n links away, so the
number of rounds is the logarithm of the longest chain.  Links that run in a circle never end; the few
blocks on or before circles are recognised by that and walked one by one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..cluster import cut
from .text import nested_texts

_REF = T.ArrayType(T.IntegerType())
MOST_ROUNDS = 40


def _links(nodes: DataFrame, key: str) -> DataFrame:
    blocks = nodes.where("kind = 'block'").select(key, "ref", "previous_part", "next_part")
    named = blocks.where("previous_part IS NOT NULL OR next_part IS NOT NULL")
    ends = named.select(key, F.explode(F.array("previous_part", "next_part")).alias("ref")).where("ref IS NOT NULL").distinct()
    return blocks.join(named.select(key, "ref").union(ends).distinct(), [key, "ref"])


def part_roots(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ref, root): where each linked block's chain begins, by its ``previous_part`` links.

    A link to a block that does not exist ends there: the root is the missing ref.  Where links run in a
    circle, the root is the first block met twice.
    """
    links = cut(_links(nodes, key))
    front = links.select(key, "ref", F.coalesce("previous_part", "ref").alias("at"), F.col("previous_part").isNull().alias("done"))
    front = cut(front)
    step = links.select(key, F.col("ref").alias("at"), F.col("previous_part").alias("_to"), F.lit(True).alias("_known"))
    front = cut(
        front.join(step, [key, "at"], "left").select(key, "ref", "at", (F.col("done") | F.col("_known").isNull() | F.col("_to").isNull()).alias("done"))
    )
    open_before = None
    for _ in range(MOST_ROUNDS):
        still = front.where("NOT done").count()
        if not still or still == open_before and _ > 1 and _circles_only(front, key):
            break
        open_before = still
        jump = front.select(key, F.col("ref").alias("at"), F.col("at").alias("_to"), F.col("done").alias("_done"))
        front = cut(
            front.join(jump, [key, "at"], "left").select(
                key, "ref", F.when(F.col("done"), F.col("at")).otherwise(F.coalesce("_to", "at")).alias("at"), (F.col("done") | F.coalesce("_done", F.lit(True))).alias("done")
            )
        )
    settled = front.where("done").select(key, "ref", F.col("at").alias("root"))
    circular = front.where("NOT done").select(key).distinct()
    if circular.isEmpty():
        return settled
    tangled = links.join(front.where("NOT done").select(key, "ref"), [key, "ref"], "left_semi").select(key, "ref", "previous_part")
    schema = T.StructType([nodes.schema[key], T.StructField("ref", _REF), T.StructField("root", _REF)])

    def walk(key_value: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        to = {tuple(r): tuple(p) for r, p in zip(pdf["ref"], pdf["previous_part"]) if p is not None}
        rows = []
        for start in map(tuple, pdf["ref"]):
            seen, at = set(), start
            while at not in seen and at in to:
                seen.add(at)
                at = to[at]
            rows.append((key_value[0], list(start), list(at)))
        return pd.DataFrame(rows, columns=schema.names)

    return settled.unionByName(tangled.groupBy(key).applyInPandas(walk, schema))


def _circles_only(front: DataFrame, key: str) -> bool:
    """Whether every block that is still open points at one that is open too, so more rounds change nothing."""
    waiting = front.where("NOT done")
    goals = front.where("done").select(key, F.col("ref").alias("at"))
    return waiting.join(goals, [key, "at"], "left_semi").isEmpty()


def part_chains(nodes: DataFrame, key: str = "doc_id", include: Column | None = None) -> DataFrame:
    """(key, root, position, ref): every chain from its root along ``next_part`` links.

    A chain stops before a block it already has, a missing one, or one for which ``include`` (over the
    columns of nodes) is not true.  A root that is excluded or missing has an empty chain.

    Every block learns by doubling which blocks without a predecessor lead to it, and over how many links;
    a chain is what its root's farthest predecessor leads to, from the root on.  Only documents whose links
    run in circles are walked link by link.
    """
    roots = part_roots(nodes, key).select(key, "root").distinct()
    blocks = nodes.where("kind = 'block'") if include is None else nodes.where("kind = 'block'").where(include)
    allowed = cut(_links(blocks, key).select(key, "ref", "next_part"))
    known = allowed.select(key, F.col("ref").alias("next_part"))
    step = allowed.where("next_part IS NOT NULL").join(known, [key, "next_part"], "left_semi")
    lone = cut(roots.join(blocks.select(key, F.col("ref").alias("root")), [key, "root"], "left_semi"))

    back = cut(step.select(key, F.col("next_part").alias("ref"), F.col("ref").alias("head"), F.lit(1).alias("hops")))
    before = None
    while True:
        up = back.select(key, F.col("ref").alias("head"), F.col("head").alias("_head"), F.col("hops").alias("_hops"))
        # a head that has predecessors itself is replaced by them
        joined = back.join(up, [key, "head"], "left")
        back = cut(joined.select(key, "ref", F.coalesce("_head", "head").alias("head"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.col("_head").isNotNull().alias("open")))
        still = back.where("open").count()
        if not still or still == before:
            break
        before, back = still, back.drop("open")
    whole = back.drop("open").unionByName(lone.select(key, F.col("root").alias("ref"), F.col("root").alias("head"), F.lit(0).alias("hops")))
    starts = whole.join(lone.withColumnRenamed("root", "ref"), [key, "ref"], "left_semi").groupBy(key, "ref").agg(F.max_by(F.struct("head", "hops"), F.struct("hops", "head")).alias("_s"))
    starts = starts.select(key, F.col("ref").alias("root"), F.col("_s.head").alias("head"), F.col("_s.hops").alias("_from"))
    told = starts.join(whole, [key, "head"]).where("hops >= _from").select(key, "root", (F.col("hops") - F.col("_from")).cast("int").alias("position"), "ref").distinct()
    if not still:
        return told
    circles = back.where("open").select(key).distinct()
    return told.join(circles, key, "left_anti").unionByName(_walked(lone.join(circles, key, "left_semi"), step, key))


def _walked(roots: DataFrame, step: DataFrame, key: str) -> DataFrame:
    """Chains of documents with circles, one document at a time: only their linked blocks."""
    schema = T.StructType([roots.schema[key], *(T.StructField(n, t) for n, t in (("root", _REF), ("position", T.IntegerType()), ("ref", _REF)))])
    links = step.select(key, F.col("ref"), F.col("next_part")).unionByName(roots.select(key, F.col("root").alias("ref"), F.lit(None).cast(_REF).alias("next_part")))

    def walk(key_value: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = [(tuple(r), None if n is None else tuple(n)) for r, n in zip(pdf["ref"], pdf["next_part"])]
        onward = {r: n for r, n in pairs if n is not None}
        rows = []
        for root in sorted({r for r, n in pairs if n is None}):
            at, met = root, {}
            while at is not None and at not in met:
                met[at] = len(met)
                at = onward.get(at)
            rows += [(key_value[0], list(root), n, list(r)) for r, n in met.items()]
        return pd.DataFrame(rows, columns=schema.names)

    return links.join(roots.select(key).distinct(), key, "left_semi").groupBy(key).applyInPandas(walk, schema)


def seam_ends(nodes: DataFrame, key: str = "doc_id", wanted: DataFrame | None = None) -> DataFrame:
    """(key, ref, first_text, last_text, last_soft): of every block, or of those ``wanted`` (key, ref), the first and last text node under it.

    ``last_soft`` is whether the last text ends in a soft hyphen of the layout.
    """
    texts = nodes.where("kind = 'text'").select(key, F.col("ref").alias("leaf"), "text", "text_map")
    spread = texts.withColumn("ref", F.explode(F.transform(F.sequence(F.lit(1), F.size("leaf") - 1), lambda n: F.slice(F.col("leaf"), F.lit(1), n))))
    if wanted is not None:
        spread = spread.join(wanted.select(key, "ref").distinct(), [key, "ref"], "left_semi")
    grouped = spread.groupBy(key, "ref").agg(F.min_by("text", "leaf").alias("first_text"), F.max_by(F.struct("text", "text_map"), F.col("leaf")).alias("_last"))
    header = F.get_json_object(F.get(F.from_json("_last.text_map", "array<string>"), F.size(F.from_json("_last.text_map", "array<string>")) - 1), "$[0]")
    soft = F.coalesce(header.try_cast("int").bitwiseAND(1) == 1, F.lit(False))
    return grouped.select(key, "ref", "first_text", F.col("_last.text").alias("last_text"), soft.alias("last_soft"))


_SPACE = "[\\t\\n\\x0b\\x0c\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def seam_separator(last_text: Column, last_soft: Column, first_text: Column) -> Column:
    """What stands between two parts: a blank between two letters or digits, else nothing."""
    both = last_text.isNotNull() & first_text.isNotNull()
    blank = last_text.rlike(_SPACE + "\\z") | first_text.rlike("^" + _SPACE)
    word = last_text.rlike("[\\p{L}\\p{N}]\\z") & first_text.rlike("^[\\p{L}\\p{N}]")
    return F.when(both & ~blank & ~F.coalesce(last_soft, F.lit(False)) & word, F.lit(" ")).otherwise(F.lit(""))


def drops_hyphen(last_text: Column, first_text: Column) -> Column:
    """Whether the hyphen at the end of a part is one of hyphenation: the next part goes on in lower case."""
    return F.coalesce(last_text.endswith("-") & first_text.rlike("^[a-z]"), F.lit(False))


def logical_texts(nodes: DataFrame, texts: DataFrame | None = None, key: str = "doc_id", include: Column | None = None) -> DataFrame:
    """(key, root, refs, text) of every chain: its parts' nested texts (key, ref, text) put together at their seams.

    Without ``texts`` they are made of the blocks that chains touch, and of no others.
    """
    chains = cut(part_chains(nodes, key, include))
    order = Window.partitionBy(key, "root").orderBy("position")
    touched = chains.select(key, F.get("ref", F.lit(0)).alias("top_index")).distinct()
    near = nodes.join(touched, [key, "top_index"], "left_semi")
    if texts is None:
        texts = nested_texts(near, key)
    told = chains.join(texts.select(key, "ref", "text"), [key, "ref"]).join(seam_ends(near, key, chains), [key, "ref"], "left")
    told = (
        told.withColumn("_sep", F.when(F.col("position") > 0, seam_separator(F.lag("last_text").over(order), F.lag("last_soft").over(order), F.col("first_text"))).otherwise(""))
        .withColumn("_cut", drops_hyphen(F.col("last_text"), F.lead("first_text").over(order)))
    )
    part = F.concat("_sep", F.when(F.col("_cut") & F.col("text").endswith("-"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")))
    gathered = told.groupBy(key, "root").agg(F.array_sort(F.collect_list(F.struct("position", "ref", part.alias("part")))).alias("parts"))
    return gathered.select(
        key, "root", F.transform("parts", lambda p: p.ref).alias("refs"), F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text")
    )
