"""Questions about page skeletons: which element holds a stretch of text, its selector, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import cut
from ..functions import css

#: Units of text in a bucket, by which stretches meet the elements around them.
BUCKET = 1_024


def element_paths(dom_nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Elements with ``path``: the element numbers from their root down to them.

    One join per level of the deepest tree, each level's rows once.
    """
    dom_nodes = dom_nodes.where(F.col(key).isNotNull())
    deepest = dom_nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return dom_nodes.withColumn("path", F.array("node_no"))
    level = dom_nodes.where("depth = 0").withColumn("path", F.array("node_no"))
    out = level
    for n in range(1, deepest + 1):
        above = level.select(key, F.col("node_no").alias("parent_no"), F.col("path").alias("_above"))
        level = dom_nodes.where(F.col("depth") == n).join(above, [key, "parent_no"]).withColumn("path", F.array_append("_above", F.col("node_no"))).select(*dom_nodes.columns, "path")
        if n % 8 == 0:
            level = cut(level)
        out = out.unionByName(level)
    return out


def selectors(dom_nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, node_no, selector) of every element: from the nearest element with an id at or above it, else from body."""
    told = dom_nodes.withColumn("_id", F.when(F.coalesce("element_id", F.lit("")) != "", F.concat(F.lit("#"), css.escape_col("element_id"))))
    told = told.withColumn("_segment", F.coalesce("_id", css.segment(F.col("tag"), F.col("index"), F.col("flags"))))
    told = cut(told.select(key, "node_no", "parent_no", "depth", "_id", "_segment"))
    deepest = told.agg(F.max("depth")).first()[0] or 0
    root = F.when(F.col("_id").isNotNull(), F.col("_id")).otherwise(F.concat(F.lit("body > "), F.col("_segment")))
    level = told.where("depth = 0").withColumn("selector", root)
    out = level
    for n in range(1, deepest + 1):
        above = level.select(key, F.col("node_no").alias("parent_no"), F.col("selector").alias("_above"))
        here = F.coalesce("_id", F.concat("_above", F.lit(" > "), "_segment"))
        level = told.where(F.col("depth") == n).join(above, [key, "parent_no"]).withColumn("selector", here).select(*told.columns, "selector")
        if n % 8 == 0:
            level = cut(level)
        out = out.unionByName(level)
    return out.select(key, "node_no", "selector")


def containing(dom_nodes: DataFrame, stretches: DataFrame, key: str = "doc_id") -> DataFrame:
    """(columns of stretches, node_no): the deepest element that contains each stretch (key, start, end), NULL if none does.

    From level to level the search goes on under the first sibling that contains the stretch.  Elements are
    spelled out as buckets of text, so a stretch only meets those around its start.
    """
    bucket = lambda c: F.floor(F.col(c) / BUCKET).cast("bigint")
    asked = stretches.withColumn("_no", F.monotonically_increasing_id())
    asked = cut(asked)
    deepest = dom_nodes.agg(F.max("depth")).first()[0]
    best = asked.select(key, "_no", "start", "end").withColumn("_at", F.lit(None).cast("int"))
    found = None
    for n in range(0, -1 if deepest is None else deepest + 1):
        elements = dom_nodes.where(F.col("depth") == n).select(key, "node_no", "parent_no", "sibling", "text_start", (F.col("text_start") + F.col("text_length")).alias("text_end"))
        elements = elements.where("text_end >= text_start").withColumn("_bucket", F.explode(F.sequence(bucket("text_start"), bucket("text_end"))))
        here = best.withColumn("_bucket", bucket("start"))
        on = here.alias("s").join(elements.alias("e"), (F.col(f"s.{key}") == F.col(f"e.{key}")) & (F.col("s._bucket") == F.col("e._bucket")) & F.col("s._at").eqNullSafe(F.col("e.parent_no")) & (F.col("text_start") <= F.col("start")) & (F.col("end") <= F.col("text_end")))
        hit = on.groupBy(F.col(f"s.{key}").alias(key), "_no", "start", "end").agg(F.min_by("node_no", "sibling").alias("_at"))
        best = cut(hit)
        if best.isEmpty():
            break
        step = best.select("_no", F.col("_at").alias("node_no"), F.lit(n).alias("depth"))
        found = step if found is None else found.unionByName(step)
    if found is None:
        return asked.drop("_no").withColumn("node_no", F.lit(None).cast("int"))
    return asked.join(found.groupBy("_no").agg(F.max_by("node_no", "depth").alias("node_no")), "_no", "left").drop("_no")


def match_selectors(dom_nodes: DataFrame, requests: DataFrame, key: str = "doc_id") -> DataFrame:
    """(columns of requests, node_no): the one element that each selector (key, selector) matches, NULL if none or several do.

    The last segment finds candidates by document and tag; each further one follows the candidates' parents.
    """
    asked = cut(requests.withColumn("_no", F.monotonically_increasing_id()).withColumn("_parsed", css.parse_col("selector")))
    elements = cut(
        dom_nodes.select(
            key, "node_no", "parent_no", "tag", "index", F.coalesce("flags", F.lit(0)).alias("flags"),
            css.escape_col(F.when(F.col("element_id") != "", F.col("element_id"))).alias("id"), css.escape_col(F.when(F.col("previous_id") != "", F.col("previous_id"))).alias("previous_id"),
        )
    )
    parsed = asked.where("_parsed.segments IS NOT NULL").select(key, "_no", F.reverse("_parsed.segments").alias("segments"), "_parsed.anchor", "_parsed.anchor_id")
    longest = parsed.agg(F.max(F.size("segments"))).first()[0] or 0

    def fits(segment):
        has = lambda bit: F.col("e.flags").bitwiseAND(F.lit(bit)) != 0
        pseudo = (
            F.when(segment.pseudo.isNull(), True)
            .when(segment.pseudo == "first-child", F.col("e.index") == 0)
            .when(segment.pseudo == "first-of-type", has(css.FIRST_OF_TYPE))
            .when(segment.pseudo == "last-child", has(css.LAST_CHILD))
            .when(segment.pseudo == "last-of-type", has(css.LAST_OF_TYPE))
            .when(segment.pseudo == "nth-child", F.col("e.index") + 1 == segment.n)
            .otherwise(False)
        )
        tag = (F.col("e.tag") == segment.tag) & (segment.previous_id.isNull() | F.coalesce(F.col("e.previous_id") == segment.previous_id, F.lit(False))) & pseudo
        return F.coalesce(F.when(segment.id.isNotNull(), F.col("e.id") == segment.id).otherwise(tag), F.lit(False))

    first = F.get(F.col("segments"), F.lit(0))
    starts = parsed.withColumns({"_tag": first.tag, "_id": first.id})
    same_doc = F.col(f"p.{key}") == F.col(f"e.{key}")
    by_tag = starts.where("_id IS NULL").alias("p").join(elements.alias("e"), same_doc & (F.col("p._tag") == F.col("e.tag")) & fits(F.get(F.col("p.segments"), F.lit(0))))
    by_id = starts.where("_id IS NOT NULL").alias("p").join(elements.alias("e"), same_doc & (F.col("p._id") == F.col("e.id")))
    columns = [F.col(f"p.{key}").alias(key), "_no", "segments", "anchor", "anchor_id", F.col("e.node_no").alias("target"), F.col("e.parent_no").alias("at")]
    front = by_tag.select(*columns).unionByName(by_id.select(*columns))
    done = None
    for n in range(1, longest + 1):
        ended = front.where(F.size("segments") == n)
        done = ended if done is None else done.unionByName(ended)
        if n == longest:
            break
        going = cut(front.where(F.size("segments") > n))
        ahead = going.alias("p").join(elements.alias("e"), (F.col(f"p.{key}") == F.col(f"e.{key}")) & (F.col("p.at") == F.col("e.node_no")) & fits(F.get(F.col("p.segments"), F.lit(n))))
        front = ahead.select(F.col(f"p.{key}").alias(key), "_no", "segments", "anchor", "anchor_id", "target", F.col("e.parent_no").alias("at"))
    if done is None:
        return asked.drop("_no", "_parsed").withColumn("node_no", F.lit(None).cast("int"))
    ids = elements.where("id IS NOT NULL").select(key, F.col("node_no").alias("at"), F.col("id").alias("_id"))
    anchored = done.join(ids, [key, "at"], "left").where(
        F.col("anchor").isNull() | (F.col("anchor") == "body") & F.col("at").isNull() | F.coalesce((F.col("anchor") == "id") & (F.col("_id") == F.col("anchor_id")), F.lit(False))
    )
    unique = anchored.groupBy("_no").agg(F.min("target").alias("_a"), F.max("target").alias("_b")).where("_a = _b").select("_no", F.col("_a").alias("node_no"))
    return asked.join(unique, "_no", "left").drop("_no", "_parsed")
