"""Operators that answer by joins and windows, against the plain walk they stand for."""

import random

from pyspark.sql import functions as F

from arbordoc.functions import css, deltamap, refs
from arbordoc.operators import dom, outline, parts, ranges, retrieval, text
from arbordoc.sources.trees import flatten
from trees import frame, paragraph, tree

NODES = "doc_id string, kind string, ref array<int>, top_index int, previous_part array<int>, next_part array<int>, clash string"


def linked(spark, links):
    """Blocks [i] of documents with next and previous links {(doc, i): j}."""
    blocks = {(d, i) for d, i in links} | {(d, j) for (d, _), j in links.items() if j is not None and j < 1_000_000}
    back = {}
    for (d, i), j in sorted(links.items()):
        back.setdefault((d, j), i)
    rows = [(d, "block", [i], i, [back[d, i]] if (d, i) in back else None, [links[d, i]] if links.get((d, i)) is not None else None, "c") for d, i in sorted(blocks)]
    return spark.createDataFrame(rows, NODES)


def chains(links, blocks, roots):
    out = set()
    for d, root in roots:
        at, met = root, []
        while at is not None and (d, at) in blocks and at not in met:
            met.append(at)
            at = links.get((d, at))
        out |= {(d, root, k, i) for k, i in enumerate(met)}
    return out


def test_part_chains_are_walked(spark):
    rng = random.Random(3)
    links = {("long", i): i + 1 for i in range(300)} | {("gap", 0): 1, ("gap", 1): 1_000_000, ("self", 4): 4}
    links |= {("ring", i): (i + 1) % 5 for i in range(5)} | {("ring", 10): 2, ("ring", 20): 21}
    links |= {("fork", 0): 5, ("fork", 1): 5, ("fork", 5): 6, ("fork", 6): 7, ("back", 9): 3, ("back", 3): 12}
    links |= {("mixed", i): rng.choice([None, rng.randrange(40)]) for i in range(40)}
    nodes = linked(spark, links)
    blocks = {(r.doc_id, r.ref[0]) for r in nodes.collect()}
    roots = {(r.doc_id, r.root[0]) for r in parts.part_roots(nodes).select("doc_id", "root").distinct().collect()}
    got = [(r.doc_id, r.root[0], r.position, r.ref[0]) for r in parts.part_chains(nodes).collect()]
    assert len(got) == len(set(got)) and set(got) == chains(links, blocks, roots & blocks)
    even = {(d, i) for d, i in blocks if i % 2 == 0 or d == "long" and i < 100}
    include = (F.col("top_index") % 2 == 0) | (F.col("doc_id") == "long") & (F.col("top_index") < 100)
    got = {(r.doc_id, r.root[0], r.position, r.ref[0]) for r in parts.part_chains(nodes, include=include).collect()}
    assert got == chains(links, even, roots & even)
    assert parts.part_chains(nodes.where("false")).count() == 0


def test_outlines_of_any_depth(spark):
    rng = random.Random(6)
    rows, expected = [], {}
    for d in range(8):
        stack = []
        for n in range(60):
            level = rng.choice([None, 0, 1, 2, 3]) if d < 4 else rng.randint(1, 30) if n % 7 else n
            title = rng.choice([f"t{n}", None])
            rows.append((d, n * 2, level, title, "c"))
            depth = min(max(level or 1, 1) - 1, len(stack))
            del stack[depth:]
            expected[d, n * 2] = (stack[-1][0] if stack else None, depth, [t for _, t in stack] + [title or ""])
            stack.append((n * 2, title or ""))
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, ord int, outline_level int, title string, parent string")
    got = {(r.doc_id, r.ord): (r.parent_ord, r.depth, r.title_path) for r in outline.paths_from_levels(df).collect()}
    assert got == expected and max(x[1] for x in expected.values()) > outline.WINDOW_DEPTHS + 2
    assert outline.paths_from_levels(df.where("false")).count() == 0


def test_stretches_meet_the_elements_around_them(spark):
    rng = random.Random(8)
    rows, at = [], 0
    for g in range(6):
        n = rng.choice([50, 3000, 9000])
        rows.append(("d", g * 1000, None, 0, g, at, n))
        inner = at
        for k in range(rng.randint(0, 30)):
            m = rng.randint(0, 400)
            rows.append(("d", g * 1000 + k + 1, g * 1000, 1, k, inner, m))
            inner += rng.choice([m, m - 20, m + 5])
        at += n
    dom_nodes = spark.createDataFrame(rows, "doc_id string, node_no int, parent_no int, depth int, sibling int, text_start long, text_length long")
    asked = [("d", rng.randint(0, at), 0) for _ in range(200)]
    asked = [(d, s, s + rng.choice([0, 1, 5, 2000])) for d, s, _ in asked] + [("x", 0, 1)]

    def holder(d, s, e):
        best, under = None, None
        for depth in (0, 1):
            inside = [r for r in rows if r[0] == d and r[3] == depth and r[2] == under and r[5] <= s and e <= r[5] + r[6]]
            if not inside:
                break
            best = under = min(inside, key=lambda r: r[4])[1]
        return best

    out = dom.containing(dom_nodes, spark.createDataFrame(asked, "doc_id string, start long, end long")).collect()
    assert len(out) == len(asked) and all(r.node_no == holder(r.doc_id, r.start, r.end) for r in out)


def test_cursors_and_characters(spark):
    trees = {"a": tree([paragraph("ab", "", "c\U0001f600d"), paragraph(""), paragraph("xy")]), "b": tree([paragraph("")])}
    nodes = flatten(frame(spark, trees), "nodes").cache()
    chars = [(r.ref, r.offset, r.char) for r in text.characters(nodes).where("doc_id = 'a'").orderBy("ref", "offset").collect()]
    assert chars == [([0, 0], 0, "a"), ([0, 0], 1, "b"), ([0, 2], 0, "c"), ([0, 2], 1, "\U0001f600"), ([0, 2], 3, "d"), ([2, 0], 0, "x"), ([2, 0], 1, "y")]
    asked = [("a", 1, [0, 0], 1), ("a", 2, [0, 0], 2), ("a", 3, [0], 0), ("a", 4, [0, 2], 9), ("a", 5, [2, 0], 2), ("a", 6, [1], None), ("a", 7, [0, 1], 0), ("a", 8, [9, 9], 0), ("b", 9, [0], 0), ("z", 10, [0], 0), ("a", 11, [], 0)]
    cursors = spark.createDataFrame(asked, "doc_id string, cursor_id int, ref array<int>, offset int")
    free = {r.cursor_id: (r.char, r.next_ref, r.next_offset) for r in text.next_chars(nodes, cursors).collect()}
    none = (None, None, 0)
    assert free == {1: ("b", [0, 0], 2), 2: ("c", [0, 2], 1), 3: ("a", [0, 0], 1), 4: ("x", [2, 0], 1), 5: none, 6: ("x", [2, 0], 1), 7: ("c", [0, 2], 1), 8: none, 9: none, 10: none, 11: none}
    confined = {r.cursor_id: r.next_ref for r in text.next_chars(nodes, cursors, confined=True).collect()}
    assert confined[4] is None and confined[6] is None and confined[2] == [0, 2] and confined[1] == [0, 0]


def test_lookups_and_range_edges(spark):
    nodes = flatten(frame(spark, {"a": tree([paragraph("ab"), paragraph("c", "d")])}), "nodes")
    asked = spark.createDataFrame([("a", [1]), ("a", [1, 1]), ("a", [1, 2]), ("a", [-1]), ("a", []), ("a", None), ("q", [0])], "doc_id string, ref array<int>")
    got = {tuple(r.ref or ["none"]): (r.kind, r.text) for r in ranges.nodes_at(nodes, asked).where("doc_id = 'a'").collect()}
    assert got == {(1,): ("block", None), (1, 1): ("text", "d"), (1, 2): (None, None), (-1,): (None, None), ("none",): (None, None)}
    one = refs.range_of(F.array(F.lit(1)), F.array(F.lit(2)), end_offset=F.lit(4))
    moved = refs.with_end(refs.with_start(one, F.array(F.lit(0))), refs.point(F.array(F.lit(9)), F.lit(1)))
    r = spark.range(1).select(one.alias("a"), moved.alias("b")).first()
    assert (list(r.a.range_start), list(r.a.range_end), list(r.b.range_start), list(r.b.range_end)) == ([1], [2, 4], [0], [9, 1])


def test_map_and_selector_columns(spark):
    df = spark.createDataFrame([("3 1", "2 1", 9), (None, "2 1", 4), ("3 1", None, 4), (None, None, 0)], "a string, b string, n int")
    for r in df.select("a", "b", "n", deltamap.compose_col("a", "b", "n").alias("c"), deltamap.merge_col("a", "b", "n").alias("m")).collect():
        assert r.c == deltamap.compose(r.a, r.b, r.n) and r.m == deltamap.merge(r.a, r.b, r.n)
    told = spark.createDataFrame([("body > p:nth-child(3)",), ("#a + p",), ("nonsense >",), (None,)], "s string").select(css.parse_col("s").alias("p")).collect()
    assert told[0].p.anchor == "body" and told[0].p.segments[0].n == 3 and told[1].p.segments[0].previous_id == "a" and told[2].p.segments is None and told[3].p.segments is None


def test_intervals_meet_over_buckets(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), s, s + rng.choice([0, 1, 3, 40])) for s in (rng.randint(-50, 300) for _ in range(150))]
    df = spark.createDataFrame([*rows, ("a", None, 3), ("a", 3, None)], "k string, start long, end long")
    expected = set()
    for k in ("a", "b", None):
        merged = []
        for s, e in sorted((s, e) for x, s, e in rows if x == k):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        expected |= {(k, s, e) for s, e in merged}
    for width in (7, 100_000):
        got = [tuple(r) for r in retrieval.merge_intervals(df, ["k"], bucket=width).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
