import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from arbordoc.functions import glyphs
from arbordoc.operators import edits, merge, retrieval
from arbordoc.sources.trees import flatten
from trees import frame, listing, paragraph, text, tree


def run(*widths, x=0, page=0, width=None):
    return [0, page, x, 0, x + (width or sum(w if not isinstance(w, list) else sum(w) for w in widths)), 10, *widths]


def anchored(value, *runs, **more):
    return text(value, anchor={"textMap": json.dumps(list(runs))}, **more)


def test_positions_and_boxes():
    assert glyphs.positions([0, 0, 1, 2, 3, 4]) == [(1, 3)]
    assert glyphs.positions([2, 0, 1, 2, 3, 4]) == [(2, 4)]
    assert glyphs.positions([0, 0, 0, 0, 9, 9, 2, [1, 3]]) == [(0, 2), (3, 6)]
    assert glyphs.glyph_boxes([[1, 0, 0, 0, 9, 9, 2, 3]]) == [([0, 0, 2, 9], 0)]
    assert glyphs.parse_runs("{") == [] and glyphs.parse_runs(None) == [] and glyphs.parse_runs('{"a":1}') == []


def test_compaction_stays_within_error():
    rng = random.Random(2)
    for _ in range(200):
        original = [0, 0, rng.uniform(0, 500), 0, 600, 10, *(rng.uniform(1, 8) if rng.random() < 0.7 else [rng.uniform(-1, 5), rng.uniform(1, 8)] for _ in range(30))]
        told = glyphs.run_errors(original, glyphs.compact(original))
        assert told["max"] <= 0.25 + 1e-6
    assert glyphs.shortest(-2.5, 0.1) == -2.5 and glyphs.half_up(-2.5, 0) == -2 and glyphs.half_up(2.5, 0) == 3
    with pytest.raises(ValueError):
        glyphs.run_errors(run(1, 2), run(1, 2, 3))


def test_compaction_column(spark):
    values = [0.0, 1.234567891, -2.5, 99.96, 1e-9]
    out = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(glyphs.shortest_col(F.col("v")).alias("x")).collect()]
    assert out == [glyphs.shortest(v, 0.25) for v in values]


def test_slices_of_noisy_runs():
    noisy = [0, 0, 108, 0, 120, 10, 4.300000000000011, 4.399999999999977]
    out = glyphs.slice_runs([noisy], list("ab"), 1, 2)
    assert glyphs.dump_runs(out) == "[[0,0,108,0,120,10,[4.3,4.4]]]"


def test_attributes_split_nodes():
    t = tree([paragraph(anchored("abc def gh", run(5, 5, 5, [5, 5], 5, 5, [5, 5], 5)))])
    ref = edits.apply_to_text(t, [0], 4, 4, lambda node: {**node, "style": {"bold": True}})
    parts = t["content"][0]["content"]
    assert ref == [0, 1] and [p["text"] for p in parts] == ["abc ", "d", "ef gh"]
    boxes = [glyphs.glyph_boxes(glyphs.parse_runs(p["anchor"]["textMap"])) for p in parts]
    assert [len(b) for b in boxes] == [3, 1, 4] and boxes[1][0][0][0] == 20 and boxes[1][0][0][2] == 25


def test_attributes_keep_page_boundaries():
    t = tree([paragraph("abcdef")], [[[0], [0, 0, 3]], [[0, 0, 3], [1]]])
    edits.apply_to_text(t, [0], 0, 0, lambda node: node)
    assert [p["text"] for p in t["content"][0]["content"]] == ["a", "bcdef"]
    assert t["catalog"]["pages"][1]["contentRange"] == [[0, 1, 2], [1]]
    t = tree([listing("Hello", "world")], [[[0], [0, 1]]])
    edits.apply_to_text(t, [0], 2, 4, lambda node: node)
    assert t["catalog"]["pages"][0]["contentRange"][1] == [0, 1, 0]
    t = tree([paragraph("abc", "def")])
    assert edits.apply_to_text(t, [0], 5, 0, lambda node: None) == [0, 0] and t["content"][0]["content"] == []
    assert edits.apply_to_text(t, [7], 0, 1, lambda node: node) is None


def test_edits_of_a_text_node():
    bold = lambda node: {**node, "style": {"bold": True}}
    fresh = lambda: tree([paragraph("Hello", " you")], [[[0, 0, 2], [0, 1]]])
    t = fresh()
    assert edits.apply_to_text(t, [0, 0], 0, 9, bold) == [0, 0] and t["content"][0]["content"][0] == {"text": "Hello", "style": {"bold": True}}
    t = fresh()
    assert edits.apply_to_text(t, [0, 0], 7, 9, bold) is None and t == fresh()
    assert edits.apply_to_text(t, [0, 0], 0, 9, lambda node: None) == [0, 0] and t == fresh()
    edits.apply_to_text(t, [0, 0], 1, 2, bold)
    assert [c["text"] for c in t["content"][0]["content"][0]["content"]] == ["H", "el", "lo"]
    json.dumps(t)
    t = fresh()
    assert edits.apply_to_text(t, [0], 2, 6, lambda node: None) == [0, 1] and [c["text"] for c in t["content"][0]["content"]] == ["He", "ou"]
    t = tree([paragraph("")])
    assert edits.apply_to_text(t, [0], 0, 0, bold) is None and edits.apply_to_text(t, [0, 0], 0, 5, bold) is None


def test_edit_trees(spark):
    trees = frame(spark, {"a": tree([paragraph("abcdef")]), "b": tree([paragraph("xyz")])})
    asked = spark.createDataFrame([("a", 1, [0], 1, 2, "bold"), ("a", 2, [0], 4, 4, "italic")], "doc_id string, edit_no int, block_ref array<int>, offset_start int, offset_end int, argument string")
    out = {r.doc_id: r for r in edits.edit_trees(trees, asked, lambda node, e: {**node, "style": {e["argument"]: True}}).collect()}
    parts = json.loads(out["a"].tree)["content"][0]["content"]
    assert [(p["text"], p.get("style")) for p in parts] == [("a", None), ("bc", {"bold": True}), ("d", None), ("e", {"italic": True}), ("f", None)]
    assert out["a"].refs == [[0, 1], [0, 3]] and out["b"].refs is None


def test_merging(spark):
    a = anchored("a", [0, 0, 108, 0, 120, 10, 4.3])
    b = anchored("b", [0, 0, 108, 0, 120, 10, [4.3, 4.4]])
    trees = frame(spark, {
        "runs": tree([paragraph(a, b, text("c"), text("d", style={"bold": True}), text("e", style={"bold": True}))]),
        "maps": tree([paragraph(text("Hello ", anchor={"selectorMap": "/1", "deltaMap": "2 -1"}), text("world", anchor={"selectorMap": "/3"}))]),
        "streams": tree([paragraph(text("x", anchor={"stream": 1}), text("y", anchor={"stream": 2}))]),
    })
    nodes = flatten(trees, "nodes").cache()
    runs = [(r.text, r.text_map) for r in merge.merge_runs(nodes.where("doc_id = 'runs'")).orderBy("first_ordinal").collect()]
    assert runs == [("ab", "[[0,0,108,0,120,10,4.3],[0,0,108,0,120,10,[4.3,4.4]]]"), ("c", None), ("de", None)]
    maps = {r.doc_id: [] for r in nodes.select("doc_id").distinct().collect()}
    for r in merge.merge_selector_maps(nodes).orderBy("first_ordinal").collect():
        maps[r.doc_id].append((r.text, r.selector_map, r.delta_map))
    assert maps["maps"] == [("Hello world", "6 /1\n5 /3", None)] and len(maps["streams"]) == 2 and len(maps["runs"]) == 5
    kept = merge.merge_selector_maps(nodes.where("doc_id = 'maps'"), preserve_delta=True).first()
    assert kept.delta_map == "2 -1"
    same = [r.text for r in merge.merge_text_nodes(nodes.where("doc_id = 'runs'")).orderBy("first_ordinal").collect()]
    assert same == ["a", "b", "c", "de"]


def char(c, x, y=0, w=5, **more):
    return {"c": c, "rect": [x, y, x + w, y + 10], "axisDir": 0, **more}


def test_text_nodes_of_characters():
    line = [char("H", 0), char("i", 5, spaceAfter=True), char("o", 12), char("n", 17, lineBreakAfter=True), char("x", 0, 20)]
    (node,) = glyphs.text_nodes(3, line)
    assert node["text"] == "Hi on x"
    runs = glyphs.parse_runs(node["anchor"]["textMap"])
    assert len(runs) == 2 and runs[0][1] == 3 and len(glyphs.glyph_boxes(runs)) == 5
    soft = [char("a", 0), char("-", 5, softHyphen=True, lineBreakAfter=True), char("b", 0, 20)]
    (node,) = glyphs.text_nodes(0, soft)
    assert node["text"] == "ab" and glyphs.parse_runs(node["anchor"]["textMap"])[0][0] & 1
    dash = [char("-", 0, lineBreakAfter=True), char("b", 0, 20)]
    assert glyphs.text_nodes(0, dash)[0]["text"] == "-b"
    styled = glyphs.text_nodes(0, [char("a", 0, spaceAfter=True), char("b", 10, bold=True)])
    assert [(n["text"], n.get("style")) for n in styled] == [("a", None), (" ", None), ("b", {"bold": True})]
    mark = glyphs.text_nodes(0, [char(" \u0308", 0), char("i", 0)])
    assert mark[0]["text"] == "i\u0308" and glyphs.text_nodes(0, []) == []


def test_preformatted_characters():
    chars = [char("a", 0, monospace=True), char("b", 15, monospace=True, lineBreakAfter=True), char("c", 10, 20, monospace=True)]
    assert glyphs.preformatted_nodes(chars) == [{"text": "a  b\n  c"}]
    assert glyphs.preformatted_nodes([]) == [] and glyphs.column_width([]) == 1


@pytest.fixture(scope="module")
def document(spark):
    p = paragraph(anchored("One two. Three.", run(*[5] * 12, x=0)), anchor={"pageRects": [[0, 0, 0, 60, 10]]})
    q = paragraph("Plain first. Plain second.", anchor={"pageRects": [[0, 0, 20, 60, 30], [0, 0, 30, 60, 40]]})
    r = listing("item one", "item two", flowClass="excluded")
    t = tree([p, q, r, paragraph("  ")], [[[0], [4]]])
    trees = frame(spark, {"d": t})
    return flatten(trees, "nodes").cache(), flatten(trees, "pages").cache()


def test_blocks_at_rects(spark, document):
    nodes, pages = document
    asked = spark.createDataFrame([("d", 1, [0.0, 60.0, 10.0, 70.0, 15.0]), ("d", 2, [0.0, 0.0, 35.0, 1.0, 36.0]), ("d", 3, [1.0, 0.0, 0.0, 9.0, 9.0]), ("d", 4, [0.0])], "doc_id string, request_id int, page_rect array<double>")
    out = sorted((r.request_id, r.range_start, r.range_end) for r in retrieval.blocks_at_rects(nodes, pages, asked).collect())
    assert out == [(1, [0], [1]), (2, [1], [2])]


def test_content(spark, document):
    nodes, _ = document
    rows = sorted((r.ref, r.sid if r.sid is not None else -1, r.text) for r in retrieval.content_sentences(nodes).collect())
    assert rows == [([0], 0, "One two."), ([0], 1, "Three."), ([1], 0, "Plain first."), ([1], 1, "Plain second."), ([3], -1, None)]
    chosen = spark.createDataFrame([("d", [0, 0, 4], [1, 0, 5]), ("d", [1, 0, 3], [1, 0, 12])], "doc_id string, range_start array<int>, range_end array<int>")
    rows = sorted((r.ref, r.text) for r in retrieval.content_sentences(nodes, chosen).collect())
    assert rows == [([0], "Three."), ([0], "two."), ([1], "Plain first.")]
    built = json.loads(retrieval.content_trees(nodes, chosen).first()["content"])
    assert built[0] == {"type": "paragraph", "ref": "0", "content": [{"sid": 0, "text": "two."}, {"sid": 1, "text": "Three."}]}


def test_sentence_rects(spark, document):
    nodes, _ = document
    asked = [("d", [0], "0"), ("d", [0], "x-s1"), ("d", [1], "1"), ("d", [1], "9"), ("d", [3], "0"), ("d", [9], "0"), ("d", [0], "no")]
    out = [r.page_rects for r in retrieval.sentence_page_rects(nodes, spark.createDataFrame(asked, "doc_id string, ref array<int>, sid string")).orderBy("ref", "sid").collect()]
    by = dict(zip(sorted((tuple(a[1]), a[2]) for a in asked), out))
    assert by[(0,), "0"] == [[0, 0, 0, 15, 10], [0, 15, 0, 35, 10]] and by[(0,), "x-s1"] == [[0, 35, 0, 60, 10]]
    assert by[(1,), "1"] == [[0, 0, 30, 60, 40]] and by[(1,), "9"] == [] and by[(9,), "0"] == [] and by[(0,), "no"] == []


def test_interval_merge(spark):
    df = spark.createDataFrame([("a", 0, 2), ("a", 2, 4), ("a", 6, 7), ("a", 1, 3), ("b", 0, 1)], "k string, start int, end int")
    assert sorted(map(tuple, retrieval.merge_intervals(df, ["k"]).collect())) == [("a", 0, 4), ("a", 6, 7), ("b", 0, 1)]


def test_pieces_do_not_touch_the_original():
    t = tree([paragraph(anchored("ab", run(5, 5)))])
    before = copy.deepcopy(t["content"][0]["content"][0])
    edits._piece(t["content"][0]["content"][0], 0, 1)
    assert t["content"][0]["content"][0] == before


def test_glyph_tables(spark):
    from arbordoc.operators import glyph_tables as gt

    t = tree([paragraph(text("a ", style={"bold": True}), anchored("b\U0001f600 c", run(5, 5, 5, [2, 5]))), listing("x")])
    nodes = flatten(frame(spark, {"d": t}), "nodes").cache()
    runs = gt.glyph_runs(nodes).collect()
    assert len(runs) == 1 and runs[0].ref == [0, 1] and [w.delta for w in runs[0].widths] == [None, None, None, 2]
    units = gt.block_units(nodes).where("root_ref = array(0)").orderBy("offset").collect()
    assert [u.offset for u in units] == list(range(7)) and "".join(u.char for u in units) == "a b\U0001f600 c"
    assert units[0].style.bold and units[0].x1 is None and (units[2].x1, units[2].x2, units[2].page_index) == (0, 5, 0) and units[5].x1 is None and units[6].x1 == 17
    told = gt.compaction_errors(nodes).first()
    assert told.runs == 1 and told.characters == 4 and told.max_error == 0


def test_encoding_in_groups(spark):
    from arbordoc.operators import glyph_tables as gt

    names = [c.split()[0] for c in gt.CHARACTERS.split(", ")]
    def row(block, no, c, x, **more):
        base = dict.fromkeys(names) | {"doc_id": "d", "page_index": 2, "block_no": block, "char_no": no, "c": c, "rect": [float(x), 0.0, x + 5.0, 10.0], "axis_dir": 0}
        return tuple((base | more)[n] for n in names)

    rows = [row(0, 1, "i", 5), row(0, 0, "H", 0), row(1, 0, "x", 0, bold=True), row(1, 1, None, 0)]
    df = spark.createDataFrame(rows, gt.CHARACTERS)
    out = gt.encode_characters(df).orderBy("block_no", "ordinal").collect()
    assert [(r.block_no, r.text, r.style) for r in out] == [(0, "Hi", None), (1, "x", '{"bold": true}')] and out[0].text_map == "[[0,2,0,0,10,10,5,5]]"
    assert [r.text_map for r in gt.encode_characters(df, preformatted=True).collect()] == [None, None]
    assert gt.encode_characters(df.where("false")).count() == 0


def test_sql_functions(spark):
    from arbordoc.functions import sql

    assert "tree_units" in sql.register(spark)
    r = spark.sql("SELECT tree_ref_key(array(1, 2)) a, tree_ref_end(array(1, 2)) b, tree_ref_starts_with(array(1, 2), array(1)) c, tree_units('a\U0001f600') d, tree_delta_source('5 -1 7 -3', 6) e, tree_is_boundary(array()) f, tree_delta_source(NULL, 4) g").first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("1,2", [1, 3], True, 3, 7, False)
