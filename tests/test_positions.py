import random

import pytest
from pyspark.sql import functions as F

from arbordoc.functions import cfi, css, deltamap
from arbordoc.operators import dom

PATH = "/6/2[ch1.xhtml]!/2/4"


def test_compose_and_merge():
    assert deltamap.compose("4 -1", "6 -2", 8) == "4 -1 5 -3"
    assert [deltamap.to_source("4 -1 5 -3", p) for p in (3, 4, 5, 8)] == [3, 5, 8, 11]
    assert deltamap.compose("2 -1", "1 -1", 4) == "1 -1 2 -2"
    assert deltamap.compose("", "1 -1", 4) == "1 -1" and deltamap.compose("1 -1", None, 4) == "1 -1" and deltamap.compose(None, "", 4) == ""
    assert deltamap.merge("2 -1", "1 -1", 5) == "2 -1 6 -2" and deltamap.merge(None, None, 3) == "" and deltamap.merge("2 -1", "0 0", 5) == "2 -1"


def test_compose_is_what_positions_say():
    rng = random.Random(1)
    for _ in range(300):
        make = lambda: " ".join(f"{p} {d}" for p, d in zip(sorted(rng.sample(range(20), 3)), sorted((-rng.randint(0, 6) for _ in range(3)), reverse=True)))  # noqa: B023, E731
        a, b = make(), make()
        both = deltamap.compose(a, b, 20)
        assert [deltamap.to_source(both, p) for p in range(21)] == [deltamap.to_source(b, deltamap.to_source(a, p)) for p in range(21)]


@pytest.fixture(scope="module")
def row(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("x")).first()["x"]


def lit(x, kind="string"):
    return F.lit(x).cast(kind)


def test_delta_columns(row):
    assert row(deltamap.to_source_col(lit("5 -1 7 -3"), lit(6, "bigint"))) == 7
    assert row(deltamap.to_source_col(lit(None), lit(6, "bigint"))) == 6 and row(deltamap.to_source_col(lit(""), lit(6, "bigint"))) == 6
    assert row(deltamap.to_source_col(lit("x y 3 -1"), lit(3, "bigint"))) == 4


def test_fragments(row):
    one, end = lit(f"{PATH}/1"), lit(f"{PATH}/3")
    n = lambda k: lit(k, "bigint")
    assert row(cfi.resolve(one, n(5)))["value"] == f"epubcfi({PATH}/1:5)"
    assert row(cfi.resolve(one, n(5), n(10)))["value"] == f"epubcfi({PATH}/1,:5,:10)"
    assert row(cfi.resolve(one, n(7), None, lit("5 -1")))["value"] == f"epubcfi({PATH}/1:8)"
    assert row(cfi.resolve_range(one, n(5), end, n(10)))["value"] == f"epubcfi({PATH},/1:5,/3:10)"
    assert row(cfi.resolve_range(lit(f"{PATH}/1"), n(100), lit("/6/4[ch2.xhtml]!/2/2/1"), n(0)))["value"] == "epubcfi(/6,/2[ch1.xhtml]!/2/4/1:100,/4[ch2.xhtml]!/2/2/1:0)"
    several = lit("5 /1\n10 /3/1")
    assert row(cfi.resolve(several, n(7)))["value"] == "epubcfi(/3/1:2)"
    assert row(cfi.resolve(several, n(3), n(7)))["value"] == "epubcfi(,/1:3,/3/1:2)"
    assert row(cfi.resolve(several, n(40)))["value"] == "epubcfi(/3/1:10)"
    assert row(cfi.expand(lit(PATH), lit("6 /1\n5 /2/1\n1 /3"))) == f"6 {PATH}/1\n5 {PATH}/2/1\n1 {PATH}/3"
    assert row(cfi.expand(lit(PATH), lit(""))) == PATH and row(cfi.expand(lit(PATH), lit("/7"))) == f"{PATH}/7"
    assert row(cfi.block_fragment(lit(PATH)))["type"] == "FragmentSelector"
    assert tuple(row(cfi.common_path(lit("/a/b/c"), lit("/a/x")))) == ("/a", "/b/c", "/x")


def test_escape():
    expected = {"1abc": "\\31 abc", "-5x": "-\\35 x", "-": "\\-", "a b": "a\\ b", "foo.bar": "foo\\.bar", "ünï_x-9": "ünï_x-9", "\x01a": "\\1 a", "": ""}
    assert {k: css.escape(k) for k in expected} == expected


@pytest.fixture(scope="module")
def skeleton(spark):
    # div [0,100) { h1 [0,20), p [21,50), p [52,80), div#sidebar [81,100) { p [82,99) } }, footer [101,120)
    rows = [
        ("d", 0, None, 0, 0, "div", 0, 3, None, None, 0, 100),
        ("d", 1, 0, 1, 0, "h1", 0, 3, None, None, 0, 20),
        ("d", 2, 0, 1, 1, "p", 1, 1, None, None, 21, 29),
        ("d", 3, 0, 1, 2, "p", 2, 2, None, "top", 52, 28),
        ("d", 4, 0, 1, 3, "div", 3, 7, "sidebar", None, 81, 19),
        ("d", 5, 4, 2, 0, "p", 0, 7, None, None, 82, 17),
        ("d", 6, None, 0, 1, "footer", 1, 7, None, None, 101, 19),
    ]
    return spark.createDataFrame(
        rows, "doc_id string, node_no int, parent_no int, depth int, sibling int, tag string, index int, flags int, element_id string, previous_id string, text_start long, text_length long"
    ).cache()


def test_selectors(skeleton):
    out = {r.node_no: r.selector for r in dom.selectors(skeleton).collect()}
    assert out[2] == "body > div > p:first-of-type" and out[6] == "body > footer" and out[5] == "#sidebar > p" and out[3] == "body > div > p:last-of-type"
    assert {r.node_no: r.path for r in dom.element_paths(skeleton).collect()}[5] == [0, 4, 5]


def test_containing(spark, skeleton):
    asked = {(25, 40): 2, (25, 70): 0, (60, 90): 0, (50, 110): None, (21, 50): 2, (52, 80): 3, (83, 90): 5}
    frame = spark.createDataFrame([("d", *k) for k in asked] + [("other", 1, 2)], "doc_id string, start long, end long")
    out = {(r.doc_id, r.start, r.end): r.node_no for r in dom.containing(skeleton, frame).collect()}
    assert {k[1:]: v for k, v in out.items() if k[0] == "d"} == asked and out["other", 1, 2] is None


def test_matching(spark, skeleton):
    expected = {
        "p": None, "p:first-of-type": None, "div p": None, "p.intro": None, "body": None, "article > p": None, "": None,
        "div > p:nth-child(3)": 3, "#sidebar > p": 5, "#sidebar": 4, "#top + p": 3, "#missing + div": None, "body > footer": 6,
        "body > p": None, "div > h1:first-child": 1,
    }
    frame = spark.createDataFrame([("d", k) for k in expected], "doc_id string, selector string")
    assert {r.selector: r.node_no for r in dom.match_selectors(skeleton, frame).collect()} == expected


def test_empty_skeleton(spark, skeleton):
    none = skeleton.where("false")
    frame = spark.createDataFrame([("d", 1, 2, "p")], "doc_id string, start long, end long, selector string")
    assert dom.containing(none, frame.drop("selector")).first()["node_no"] is None
    assert dom.match_selectors(none, frame.select("doc_id", "selector")).first()["node_no"] is None
    assert dom.selectors(none).count() == 0 and dom.element_paths(none).count() == 0
