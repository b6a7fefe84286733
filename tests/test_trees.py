import json
import random

import pytest
from pyspark.sql import functions as F

from arbordoc.functions import refs
from arbordoc.functions.utf16 import js_trim, strip_line_ends, u16_len, u16_slice
from arbordoc.operators import chunker, outline, ranges, text
from arbordoc.operators.carry import carry_forward
from arbordoc.sources import trees as src
from trees import listing, paragraph, tree
from trees import text as t

LONG = "A sentence of more than thirty units stands here."


def test_utf16(spark):
    rows = [("a\U0001f600b",), ("abc",), ("",), (None,), (" é ",)]
    df = spark.createDataFrame(rows, "x string")
    assert [r[0] for r in df.select(u16_len(F.col("x"))).collect()] == [4, 3, 0, None, 3]
    assert [r[0] for r in df.select(u16_slice(F.col("x"), F.lit(1), F.lit(3))).collect()] == ["\U0001f600", "bc", "", None, "é "]
    trims = spark.createDataFrame([("﻿  x\u0085 \t",), ("a \t\nb\t",)], "x string")
    assert [r[0] for r in trims.select(js_trim(F.col("x"))).collect()] == ["x\u0085", "a \t\nb"]
    assert [r[0] for r in trims.select(strip_line_ends(F.col("x"))).collect()] == ["﻿  x\u0085", "a\nb"]


def test_refs(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<int>")
    assert value(arr(1) < arr(1, 0)) and value(arr(1, 2) < arr(1, 10)) and value(arr(0, 9) < arr(1))
    assert value(refs.ref_key(arr(1, 2))) == "1,2" and value(refs.ref_key(F.lit(None).cast("array<int>"))) == ""
    assert value(refs.starts_with(arr(1, 2, 3), arr(1, 2))) and not value(refs.starts_with(arr(1), arr(1, 2))) and value(refs.starts_with(arr(1), arr()))
    assert value(refs.is_boundary(arr(0))) and not value(refs.is_boundary(arr())) and not value(refs.is_boundary(arr(-1))) and not value(refs.is_boundary(F.lit(None).cast("array<int>")))
    assert value(refs.ref_end(arr(1, 2))) == [1, 3] and value(refs.point(arr(1), F.lit(4))) == [1, 4]
    span = lambda a, b, n: (lambda s: s and tuple(s))(value(refs.block_span(arr(*a), arr(*b), F.lit(n))))
    assert span([0], [2], 5) == (0, 2) and span([0], [2, 1], 5) == (0, 3) and span([1], [1], 5) == (1, 1) and span([6], [7], 5) is None
    assert span([0], [5], 5) == (0, 5) and span([0], [5, 1], 5) == (0, 5) and span([3], [1], 5) == (3, 3) and span([0], [6], 5) is None


@pytest.fixture(scope="module")
def flat(spark):
    content = [
        paragraph("Heading"),
        paragraph(LONG, " More.", anchor={"pageRects": [[1, 0, 0, 5, 5], [0, 1, 1, 2, 2]]}),
        listing("one", "", "two"),
        paragraph("gone " + LONG, flowClass="excluded"),
        paragraph("Short head"),
        paragraph("tiny"),
        paragraph("Third"),
        {"type": "blockquote", "content": [paragraph(LONG), t("loose text"), listing("x")]},
        paragraph("  "),
        paragraph(""),
    ]
    items = [
        {"title": "Main", "ref": [0], "children": [{"title": "Sub", "ref": [4]}, {"title": "", "ref": [5], "children": [{"title": "hidden", "ref": [5]}]}, {"title": "Third", "ref": [6], "source": "native", "target": {"url": "u", "position": {"pageIndex": 1}}}]},
        {"title": "No place"},
    ]
    d = tree(content, [[[0], [4]], [[4], [8, 0, 0]], [[99], [100]], [[0], [0]]], outline=items)
    other = tree([paragraph(LONG)], [])
    frame_ = spark.createDataFrame([("d", json.dumps(d)), ("o", json.dumps(other)), ("bad", "{"), ("list", "[1]"), ("null", None)], "doc_id string, tree string")
    return {k: v.cache() for k, v in src.tables(frame_).items()}


def test_flatten(flat):
    assert {r.doc_id: r.block_count for r in flat["documents"].collect()} == {"d": 10, "o": 1}
    node = flat["nodes"].where("doc_id = 'd' AND ref = array(7, 2, 0, 0)").first()
    assert node.kind == "text" and node.text == "x" and node.ref_end == [7, 2, 0, 1] and node.depth == 4 and node.top_index == 7
    page = flat["pages"].where("doc_id = 'd' AND page_index = 1").first()
    assert page.range_end == [8, 0, 0] and page.rotation == 0 and page.user_unit == 1.0


def test_nested_text(flat):
    texts = {tuple(r.ref): (r.text, r.leaf_count) for r in text.nested_texts(flat["nodes"].where("doc_id = 'd'")).collect()}
    assert texts[(2,)] == ("one\ntwo", 3) and texts[(7,)] == (LONG + "\nx", 3) and texts[(9,)] == ("", 1) and texts[(2, 1)] == ("", 1)


def _chunks(flat):
    entries = flat["outline"].select("doc_id", "ord", F.get("ref", F.lit(0)).alias("block_index"), outline.outline_path().alias("outline_path"))
    return chunker.section_chunks(text.top_level_blocks(flat["nodes"]), entries)


def test_chunks(flat):
    out = {(r.doc_id, r.start_block_index): r for r in _chunks(flat).collect()}
    assert set(out) == {("d", 0), ("d", 6), ("o", 0)}
    first = out["d", 0]
    assert (first.end_block_index, first.leaf_block_count, first.outline_path, first.text) == (2, 5, "Main", LONG + " More.\none\ntwo")
    assert first.page_rects == [[0, 1, 1, 2, 2], [1, 0, 0, 5, 5]]
    last = out["d", 6]
    assert (last.end_block_index, last.outline_path, last.text) == (8, "Main > Third", LONG + "\nx\n  ") and out["o", 0].outline_path == ""
    assert chunker.next_chunk(_chunks(flat)).where("doc_id = 'd'").first().start_block_index == 0


def test_next_chunk_from_any_block(spark):
    rng = random.Random(5)
    blocks, entries, want = [], [], set()
    for d in range(60):
        rows = [(d, k, rng.choice(["", "short", "tiny text", LONG, LONG + " more"]), rng.choice([None, None, None, "excluded", "auxiliary"]), rng.randint(1, 3)) for k in range(rng.randint(1, 14))]
        heads = [(d, o, rng.randrange(len(rows) + 2), f"h{o}") for o in range(rng.randint(0, 5))]
        blocks, entries = blocks + rows + rows[:1], entries + heads
        for start in range(-1, len(rows) + 2):
            at, n = start, len(rows)
            while 0 <= at < n:
                while at < n and rows[at][3] == "excluded":
                    at += 1
                if at >= n:
                    break
                end = min([h[2] for h in heads if h[2] > at] + [n]) - 1
                end = min(end, n - 1)
                while end > at and not (rows[end][3] != "excluded" and rows[end][2]):
                    end -= 1
                path = max(((h[2], h[1], h[3]) for h in heads if h[2] <= at), default=(0, 0, ""))[2]
                told = [r for r in rows[at + any(h[2] == at for h in heads) : end + 1] if r[3] != "excluded"]
                text_ = "\n".join(r[2] for r in told if r[2])
                if len(text_) >= 30:
                    want.add((d, start, at, end, sum(r[4] for r in told), path, text_))
                    break
                at = end + 1
    asked = spark.createDataFrame([(d, k) for d in range(60) for k in range(-1, 17)], "doc_id int, from_block_index int")
    blocks = spark.createDataFrame(blocks, "doc_id int, block_index int, text string, flow_class string, leaf_block_count int")
    entries = spark.createDataFrame(entries, "doc_id int, ord int, block_index int, outline_path string")
    out = chunker.next_chunk_from(blocks, entries, asked).drop("page_rects").collect()
    assert len(out) == len(want) and {tuple(r[c] for c in ("doc_id", "from_block_index", "start_block_index", "end_block_index", "leaf_block_count", "outline_path", "text")) for r in out} == want
    assert any(start not in (0, at) for _, start, at, *_ in want)


def test_outline(flat):
    built = json.loads(outline.export_outline(flat["outline"]).first()["outline"])
    assert built[0]["children"] == [{"title": "Sub", "startRef": "4"}, {"title": "Third", "startRef": "6", "url": "u", "position": {"pageIndex": 1}, "source": "native"}]
    assert built[1] == {"title": "No place"}


def test_levels(spark):
    rows = [("a", i, level, f"t{i}") for i, level in enumerate([2, 2, 3, 1, 4, 2, 9, None])]
    df = spark.createDataFrame(rows + rows[:1], "doc_id string, ord int, outline_level int, title string")
    out = [(r.ord, r.parent_ord, r.depth, r.title_path) for r in outline.paths_from_levels(df).orderBy("ord").collect()]
    assert out[:3] == [(0, None, 0, ["t0"]), (1, 0, 1, ["t0", "t1"]), (2, 1, 2, ["t0", "t1", "t2"])]
    assert out[3][1] is None and out[4][1] == 3 and out[5][1] == 3 and out[6][1] == 5 and out[7][2] == 0


def test_ranges(flat):
    covered = sorted((r.page_index, r.ref) for r in ranges.leaves_in_ranges(flat["nodes"], flat["pages"].select("doc_id", "page_index", "range_start", "range_end")).collect())
    assert covered == [(0, [0]), (0, [1]), (0, [2, 0]), (0, [2, 1]), (0, [2, 2]), (0, [3]), (1, [4]), (1, [5]), (1, [6]), (1, [7, 0]), (1, [7, 2, 0]), (1, [8])]
    spans = {r.page_index: (r.start_index, r.end_index) for r in ranges.page_spans(flat["pages"], ranges.block_counts(flat["nodes"])).where("doc_id = 'd'").collect()}
    assert spans == {0: (0, 4), 1: (4, 9), 2: (None, None), 3: (0, 0)}


def test_navigation(spark, flat):
    order = {tuple(r.ref): r.next_ref for r in text.next_block_refs(flat["nodes"].where("doc_id = 'd'")).collect()}
    assert order[(1,)] == [2] and order[(2,)] == [2, 0] and order[(2, 2)] == [3] and order[(9,)] is None
    asked = spark.createDataFrame([("d", [1], 60, 45)], "doc_id string, root_ref array<int>, offset_start int, offset_end int")
    hit = [(r.ref, r.offset, r.end_offset) for r in text.text_nodes_at(flat["nodes"], asked).orderBy("ref").collect()]
    assert hit == [([1, 0], 45, len(LONG) - 1), ([1, 1], 0, 5)]
    cursors = spark.createDataFrame([("d", 1, [2], 0), ("d", 2, [2, 0, 0], 3), ("d", 3, [2, 2, 0], 1), ("d", 4, [9], 0), ("d", 5, [2, 5], 0)], "doc_id string, cursor_id int, ref array<int>, offset int")
    out = {r.cursor_id: (r.char, r.next_ref, r.next_offset) for r in text.next_chars(flat["nodes"], cursors).collect()}
    assert out == {1: ("o", [2, 0, 0], 1), 2: ("t", [2, 2, 0], 1), 3: ("w", [2, 2, 0], 2), 4: (None, None, 0), 5: ("g", [3, 0], 1)}
    inside = {r.cursor_id: r.char for r in text.next_chars(flat["nodes"], cursors, confined=True).collect()}
    assert inside[2] == "t" and inside[5] is None
    stream = [(r.offset, r.char) for r in text.characters(flat["nodes"].where("doc_id = 'd'")).where("block = 2").orderBy("ref", "offset").collect()]
    assert "".join(c for _, c in stream) == "onetwo"


def test_carry(spark):
    df = spark.createDataFrame([("a", i, i // 7 if i % 7 == 3 else None) for i in range(40)], "k string, p int, v int")
    for bucket in (4, 1000):
        out = [r.x for r in carry_forward(df, "k", "p", F.col("v"), "x", bucket).orderBy("p").collect()]
        assert out == [None if i < 3 else (i - 3) // 7 for i in range(40)]


def test_empty(spark, flat):
    none = {k: v.where("false") for k, v in flat.items()}
    assert _chunks(none).count() == 0 and outline.export_outline(none["outline"]).count() == 0 and text.nested_texts(none["nodes"]).count() == 0
