import random

import pytest
from pyspark.sql import functions as F

from arbordoc.operators import fulltext as ft
from arbordoc.operators import parts
from arbordoc.operators.text import nested_texts
from arbordoc.sources.trees import flatten
from trees import frame, listing, paragraph, tree

P, L = paragraph, listing

CASES = {
    "mixed": (tree([P("abcdef"), L("hello", "world"), P("outside")], [[[0], [2]], [[2], [3]]]),
              {(0,): "abcdef\n\nhello\nworld", (1,): "outside", (1, 0): "outside\n\nabcdef\n\nhello\nworld"}),
    "linked": (tree([P("abcdef", nextPart=[1]), P("ghij", previousPart=[0])], [[[0], [2]]]), {(0,): "abcdef ghij"}),
    "cut": (tree([P("first-half second-half", nextPart=[1]), P("continuation.", previousPart=[0])], [[[0], [0, 0, 11]], [[0, 0, 11], [2]]]),
            {(0, 1): "first-half second-half continuation.", (0,): "first-half", (1,): "second-half continuation."}),
    "hyphen": (tree([P("hyphen-", nextPart=[1]), P("ated", previousPart=[0])], [[[0], [2]]]), {(0,): "hyphenated"}),
    "hard hyphen": (tree([P("Object-", nextPart=[1]), P("Shape", previousPart=[0])], [[[0], [2]]]), {(0,): "Object-Shape"}),
    "list end": (tree([P("before list"), L("first item", "second item")], [[[0], [1, 0]], [[1, 0], [2]]]),
                 {(0,): "before list", (1,): "first item\nsecond item"}),
    "list cut": (tree([L("first item", "second item")], [[[0, 0], [0, 1]], [[0, 1], [0, 2]]]), {(0, 1): "first item\nsecond item"}),
    "item to item": (tree([{"type": "list", "content": [{"type": "listitem", "content": [{"text": "programming"}], "nextPart": [1, 0]}]},
                           {"type": "list", "content": [{"type": "listitem", "content": [{"text": "and is used"}], "previousPart": [0, 0]}]}], [[[0], [2]]]),
                     {(0,): "programming and is used"}),
    "halves": (tree([P("abcdef")], [[[0, 0, 0], [0, 0, 3]], [[0, 0, 3], [0, 0, 6]]]), {(0,): "abc", (1,): "def", (0, 1): "abcdef", (1, 0): "defabc"}),
    "inside": (tree([P("abc"), P("def"), P("ghi")], [[[0, 0, 1], [2, 0, 2]]]), {(0,): "bc\n\ndef\n\ngh"}),
    "empty": (tree([P("visible")], [[[0], [0]], [[0], [1]], [[1], [1]]]), {(0,): "", (1,): "visible", (2,): "", (7,): "", (1, 1): "visible\n\nvisible"}),
    "excluded": (tree([P("gone", flowClass="excluded"), L("stays", flowClass="excluded"), P("end  ")], [[[0], [3]]]), {(0,): "stays\n\nend"}),
    "astral": (tree([P("a\U0001f600bc\U0001f600d")], [[[0, 0, 1], [0, 0, 5]]]), {(0,): "\U0001f600bc"}),
}


@pytest.fixture(scope="module")
def answers(spark):
    trees = frame(spark, {k: t for k, (t, _) in CASES.items()})
    nodes, pages = flatten(trees, "nodes").cache(), flatten(trees, "pages").cache()
    requests = [(k, ",".join(map(str, p)), n, page) for k, (_, asked) in CASES.items() for p in asked for n, page in enumerate(p)]
    requests = spark.createDataFrame(requests, "doc_id string, request_id string, position int, page_index int")
    return {(r.doc_id, r.request_id): r.text for r in ft.fulltext(nodes, pages, requests).collect()}


@pytest.mark.parametrize("name", CASES)
def test_cases(answers, name):
    for asked, expected in CASES[name][1].items():
        assert answers[name, ",".join(map(str, asked))] == expected


def _random_tree(rng):
    words = ["alpha", "beta-", "gamma ", " delta", "eps.", "Zeta", "-", ""]
    blocks, leaves = [], []
    for i in range(rng.randint(1, 6)):
        if rng.random() < 0.3:
            items = [rng.choice(words) for _ in range(rng.randint(1, 3))]
            blocks.append(L(*items))
            leaves += [[i, k] for k in range(len(items))]
        else:
            blocks.append(P(*(rng.choice(words) for _ in range(rng.randint(1, 3)))))
            leaves.append([i])
    for a, b in zip(leaves, leaves[1:]):
        if rng.random() < 0.4:
            get(blocks, a)["nextPart"] = b
            get(blocks, b)["previousPart"] = a
    if rng.random() < 0.2 and len(leaves) > 1:
        get(blocks, leaves[-1])["nextPart"] = leaves[0]
    cuts = sorted(rng.sample(range(len(leaves) + 1), min(2, len(leaves) + 1)))
    points = [[0], *[leaves[c] if c < len(leaves) else [len(blocks)] for c in cuts], [len(blocks)]]
    return tree(blocks, [list(x) for x in zip(points, points[1:])])


def get(blocks, ref):
    node = {"content": blocks}
    for k in ref:
        node = node["content"][k]
    return node


def test_relational_and_stepwise_agree(spark):
    rng = random.Random(3)
    trees = {f"t{i}": _random_tree(rng) for i in range(60)}
    flat = frame(spark, trees)
    nodes, pages = flatten(flat, "nodes").cache(), flatten(flat, "pages").cache()
    requests = pages.select("doc_id", F.lit(0).alias("request_id"), F.col("page_index").alias("position"), "page_index")
    slices = ft.page_slices(nodes, pages, requests).join(parts.seam_ends(nodes), ["doc_id", "ref"], "left").cache()
    plain = ft._plain(slices, "doc_id").where("plain").select("doc_id", "request_id")
    some = slices.join(plain, ["doc_id", "request_id"], "left_semi").cache()
    a = {r.doc_id: r.text for r in ft._relational(some, "doc_id").collect()}
    b = {r.doc_id: r.text for r in ft._stepwise(some, "doc_id").collect()}
    assert len(a) > 30 and a == b


def test_logical_text(spark):
    trees = frame(spark, {
        "a": tree([P("one-", nextPart=[1]), P("two", nextPart=[2], previousPart=[0]), P("three", previousPart=[1]), P("alone")]),
        "circle": tree([P("x", nextPart=[1], previousPart=[1]), P("y", nextPart=[0], previousPart=[0])]),
        "missing": tree([P("x", nextPart=[9])]),
    })
    nodes = flatten(trees, "nodes").cache()
    out = {(r.doc_id, tuple(r.root)): r.text for r in parts.logical_texts(nodes, nested_texts(nodes)).collect()}
    assert out["a", (0,)] == "onetwo three"
    assert out["missing", (0,)] == "x"
    roots = {(r.doc_id, tuple(r.ref)): tuple(r.root) for r in parts.part_roots(nodes).collect()}
    assert roots["a", (2,)] == (0,) and roots["circle", (0,)] == (0,) and roots["circle", (1,)] == (1,)
    assert out["circle", (0,)] == "x y" and out["circle", (1,)] == "y x"
    cut = {(r.doc_id, tuple(r.root)): r.text for r in parts.logical_texts(nodes, nested_texts(nodes), include=F.col("top_index") < 2).collect()}
    assert cut["a", (0,)] == "onetwo"


def test_empty_tables(spark):
    trees = frame(spark, {"e": tree([], [])})
    nodes, pages = flatten(trees, "nodes"), flatten(trees, "pages")
    assert ft.page_texts(nodes, pages).count() == 0
    assert parts.logical_texts(nodes, nested_texts(nodes)).count() == 0
