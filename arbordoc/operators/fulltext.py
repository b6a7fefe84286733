"""The text of chosen pages, in reading order.

A request names pages of a document in order.  Every leaf block that a page covers gives the slice of its
text that lies on the page; slices become one text, with the parts of a continued block brought together
and joined at their seams.  Requests whose pages ascend, and whose blocks continue forward and without
forks, are answered by one relational plan; the order of the others depends on what was emitted before,
so their slices, and theirs alone, are put in order by a group function.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..cluster import cut
from ..functions import refs
from ..functions.utf16 import BLANKS_TEXT, js_trim, strip_line_ends, u16_len, u16_slice
from .parts import drops_hyphen, seam_ends, seam_separator
from .ranges import leaves_in_ranges, split_points


def page_slices(nodes: DataFrame, pages: DataFrame, requests: DataFrame, key: str = "doc_id") -> DataFrame:
    """The slices of every request (key, request_id, position, page_index), with their boundaries and links.

    Unknown pages give nothing; slices without text are left out.  Excluded leaves have none; whether a
    container is excluded does not matter.
    """
    asked = requests.select(key, "request_id", "position", "page_index").join(pages.select(key, "page_index", "range_start", "range_end"), [key, "page_index"])
    bounded = split_points(split_points(asked, nodes, key, "range_start").withColumnsRenamed({"point_ref": "start_ref", "point_offset": "start_offset"}), nodes, key, "range_end")
    bounded = bounded.withColumnsRenamed({"point_ref": "end_ref", "point_offset": "end_offset"})
    covered = leaves_in_ranges(nodes, bounded, key)
    blocks = nodes.where("kind = 'block' AND is_leaf AND coalesce(flow_class, '') <> 'excluded'").select(key, "ref", "previous_part", "next_part")
    texts = nodes.where("kind = 'text' AND text <> ''").select(key, F.col("parent_ref").alias("ref"), F.col("ref").alias("seg"), "text")
    seg, leaf = F.col("seg"), F.col("ref")
    start_in, end_in = refs.starts_with(F.col("start_ref"), leaf), refs.starts_with(F.col("end_ref"), leaf)
    kept = (~start_in | (seg >= F.col("start_ref"))) & (~end_in | F.when(F.col("end_offset").isNull(), seg < F.col("end_ref")).otherwise(seg <= F.col("end_ref")))
    low = F.when(start_in & (seg == F.col("start_ref")), F.coalesce("start_offset", F.lit(0))).otherwise(F.lit(0))
    high = F.when(end_in & (seg == F.col("end_ref")) & F.col("end_offset").isNotNull(), F.col("end_offset")).otherwise(u16_len(F.col("text")))
    sliced = covered.join(blocks, [key, "ref"]).join(texts, [key, "ref"]).where(kept).withColumn("piece", u16_slice(F.col("text"), low, high))
    by = [key, "request_id", "position", "page_index", "ref", "start_ref", "start_offset", "end_ref", "end_offset", "previous_part", "next_part"]
    gathered = sliced.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seg", "piece"))).alias("pieces"))
    return gathered.withColumn("text", F.array_join(F.transform("pieces", lambda p: p.piece), "")).drop("pieces").where("text <> ''")


def _plain(slices: DataFrame, key: str) -> DataFrame:
    """(key, request_id, plain): whether the relational plan answers a request."""
    pages = slices.select(key, "request_id", "position", "page_index").distinct()
    ascending = pages.withColumn("_up", F.col("page_index") > F.lag("page_index").over(Window.partitionBy(key, "request_id").orderBy("position")))
    up = ascending.groupBy(key, "request_id").agg(F.coalesce(F.bool_and("_up"), F.lit(True)).alias("up"))
    links = slices.where("next_part IS NOT NULL").select(key, "request_id", "ref", "next_part").distinct()
    named = links.groupBy(key, "request_id", "next_part").agg(F.count("*").alias("n"), F.max("ref").alias("last"))
    forward = named.groupBy(key, "request_id").agg(F.bool_and((F.col("n") == 1) & (F.col("last") < F.col("next_part"))).alias("forward"))
    return up.join(forward, [key, "request_id"], "left").select(key, "request_id", (F.col("up") & F.coalesce("forward", F.lit(True))).alias("plain"))


def _with_roots(slices: DataFrame, key: str) -> DataFrame:
    """Slices with ``root`` (first block of their chain among the request's blocks) and ``hops`` from it."""
    chosen = slices.select(key, "request_id", "ref", "next_part").distinct()
    back = (
        chosen.where("next_part IS NOT NULL").select(key, "request_id", F.col("next_part").alias("ref"), F.col("ref").alias("root"))
        .join(chosen.select(key, "request_id", "ref"), [key, "request_id", "ref"], "left_semi")
        .withColumn("hops", F.lit(1))
    )
    back = cut(back)
    if not back.isEmpty():
        while True:
            up = back.select(key, "request_id", F.col("ref").alias("root"), F.col("root").alias("_root"), F.col("hops").alias("_hops"))
            joined = back.join(up, [key, "request_id", "root"], "left")
            longer = cut(joined.select(key, "request_id", "ref", F.coalesce("_root", "root").alias("root"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.col("_root").isNotNull().alias("_moved")))
            moved = not longer.where("_moved").isEmpty()
            back = longer.drop("_moved")
            if not moved:
                break
    return slices.join(back, [key, "request_id", "ref"], "left").withColumn("root", F.coalesce("root", "ref")).withColumn("hops", F.coalesce("hops", F.lit(0)))


def _neighbours(a_ref, a_next, a_previous, b_ref, b_next, b_previous):
    return refs.same_ref(a_next, b_ref) | refs.same_ref(b_previous, a_ref) | refs.same_ref(a_previous, b_ref) | refs.same_ref(b_next, a_ref)


def _finish(text):
    return js_trim(strip_line_ends(text))


def _relational(slices: DataFrame, key: str) -> DataFrame:
    by = Window.partitionBy(key, "request_id")
    placed = _with_roots(slices, key).withColumn("entry", F.struct("position", "ref"))
    placed = placed.withColumn("_first", F.min("entry").over(Window.partitionBy(key, "request_id", "root", "hops")))
    roots = placed.where("hops = 0").groupBy(key, "request_id", "root").agg(F.min("entry").alias("_root_entry"))
    placed = placed.join(roots, [key, "request_id", "root"], "left")
    order = by.orderBy(F.coalesce("_root_entry", "_first"), "hops", "entry")
    before = {c: F.lag(c).over(order) for c in ("ref", "root", "next_part", "previous_part", "end_ref", "end_offset", "start_ref", "start_offset", "last_text", "last_soft")}
    seam = seam_separator(before["last_text"], before["last_soft"], F.col("first_text"))
    point = lambda ref_a, off_a, ref_b, off_b: refs.same_ref(ref_a, ref_b) & off_a.eqNullSafe(off_b)
    same = F.col("ref") == before["ref"]
    touching = same & (
        point(before["end_ref"], before["end_offset"], F.col("start_ref"), F.col("start_offset"))
        | point(F.col("end_ref"), F.col("end_offset"), before["start_ref"], before["start_offset"])
    )
    neighbours = _neighbours(before["ref"], before["next_part"], before["previous_part"], F.col("ref"), F.col("next_part"), F.col("previous_part"))
    separator = (
        F.when(before["ref"].isNull(), "")
        .when((F.col("root") == before["root"]) & ~same, seam)
        .when(touching, "")
        .when(neighbours, seam)
        .when(same, "\n\n")
        .when(F.get("ref", F.lit(0)) == F.get(before["ref"], F.lit(0)), "\n")
        .otherwise("\n\n")
    )
    following = {c: F.lead(c).over(order) for c in ("ref", "root", "first_text")}
    cut_off = (F.col("root") == following["root"]) & (F.col("ref") != following["ref"]) & drops_hyphen(F.col("last_text"), following["first_text"]) & F.col("text").endswith("-")
    emitted = placed.select(
        key, "request_id", F.row_number().over(order).alias("n"),
        F.concat(separator, F.when(F.coalesce(cut_off, F.lit(False)), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))).alias("piece"),
    )
    gathered = emitted.groupBy(key, "request_id").agg(F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("pieces"))
    return gathered.select(key, "request_id", _finish(F.array_join(F.transform("pieces", lambda p: p.piece), "")).alias("text"))


def _stepwise(slices: DataFrame, key: str) -> DataFrame:
    """The same for any order of pages and any links, one request at a time."""
    schema = T.StructType([slices.schema[key], slices.schema["request_id"], T.StructField("text", T.StringType())])
    def as_ref(value):
        return None if value is None else tuple(int(x) for x in value)

    def emit(key_values: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.to_dict("records"):
            r = {k: as_ref(v) if k in ("ref", "start_ref", "end_ref", "previous_part", "next_part") else None if not isinstance(v, (str, dict, list)) and pd.isna(v) else v for k, v in r.items()}
            rows.append(r)
        rows.sort(key=lambda r: (r["position"], r["ref"]))
        by_ref: dict = {}
        for i, r in enumerate(rows):
            by_ref.setdefault(r["ref"], []).append(i)
        done: set[int] = set()
        out: list[str] = []
        previous = None

        for i, r in enumerate(rows):
            if i in done:
                continue
            met, head, chain = set(), i, []
            while head is not None and head not in done and rows[head]["ref"] not in met:
                ref = rows[head]["ref"]
                met.add(ref)
                chain += [j for j in by_ref[ref] if j not in done]
                onward = by_ref.get(rows[head]["next_part"]) if rows[head]["next_part"] is not None else None
                head = onward[0] if onward else None
            for k, j in enumerate(chain):
                r, p = rows[j], previous
                if k and p["ref"] != r["ref"]:
                    if _drop(p, r) and out and out[-1].endswith("-"):
                        out[-1] = out[-1][:-1]
                    out.append(_seam(p, r))
                elif p is not None:
                    out.append(_between(p, r))
                out.append(r["text"])
                done.add(j)
                previous = r
        return pd.DataFrame([(*key_values, "".join(out))], columns=schema.names)

    joined = slices.groupBy(key, "request_id").applyInPandas(emit, schema)
    return joined.withColumn("text", _finish(F.col("text")))


def _word(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


def _seam(a: dict, b: dict) -> str:
    last, first = a["last_text"], b["first_text"]
    if not last or not first or last[-1] in BLANKS_TEXT or first[0] in BLANKS_TEXT or a["last_soft"]:
        return ""
    return " " if _word(last[-1]) and _word(first[0]) else ""


def _drop(a: dict, b: dict) -> bool:
    return bool(a["last_text"]) and a["last_text"].endswith("-") and bool(b["first_text"]) and "a" <= b["first_text"][0] <= "z"


def _between(a: dict, b: dict) -> str:
    same = a["ref"] == b["ref"]
    point = lambda x, y, side_x, side_y: x[side_x + "_ref"] is not None and x[side_x + "_ref"] == y[side_y + "_ref"] and x[side_x + "_offset"] == y[side_y + "_offset"]
    if same and (point(a, b, "end", "start") or point(b, a, "end", "start")):
        return ""
    if a["next_part"] == b["ref"] or b["previous_part"] == a["ref"] or a["previous_part"] == b["ref"] or b["next_part"] == a["ref"]:
        return _seam(a, b)
    if same:
        return "\n\n"
    return "\n" if a["ref"][0] == b["ref"][0] else "\n\n"


def fulltext(nodes: DataFrame, pages: DataFrame, requests: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, request_id, text) for every request (key, request_id, position, page_index); '' where pages have no text."""
    slices = cut(page_slices(nodes, pages, requests, key))
    # seams are only between blocks that continue one another
    linked = slices.where("next_part IS NOT NULL OR previous_part IS NOT NULL")
    ends = F.explode(F.array_compact(F.array("ref", "next_part", "previous_part")))
    slices = slices.join(seam_ends(nodes, key, linked.select(key, ends.alias("ref"))), [key, "ref"], "left")
    sorted_out = cut(_plain(slices, key))
    plain = slices.join(sorted_out.where("plain").select(key, "request_id"), [key, "request_id"], "left_semi")
    answered = _relational(plain, key)
    if not sorted_out.where("NOT plain").isEmpty():
        rest = slices.join(sorted_out.where("NOT plain").select(key, "request_id"), [key, "request_id"], "left_semi")
        answered = answered.unionByName(_stepwise(rest, key))
    everyone = requests.select(key, "request_id").distinct()
    return everyone.join(answered, [key, "request_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def page_texts(nodes: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page_index, text) of every page by itself."""
    requests = pages.select(key, F.col("page_index").alias("request_id"), F.lit(0).alias("position"), "page_index")
    return fulltext(nodes, pages, requests, key).withColumnRenamed("request_id", "page_index")
