import itertools
import random
import unicodedata

from arbordoc.functions import deltamap
from arbordoc.functions.utf16 import py_len, py_slice
from arbordoc.llm.lookalike import lookalike_classes, lookalike_pairs, lookalike_spellings, unify_texts
from arbordoc.llm.skeleton import lookalikes, skeleton, unify

SAME = [
    ("Compass", "Ｃｏｍｐａｓｓ"), ("Compass", "Com​pa­ss"), ("a b", "a b"), ("a b", "a b"), ("a b", "a　b"), ("é", "é"),
    ("Å", "Å"), ("office", "oﬃce"), ("scope", "ѕсоре"), ("a-b", "a‑b"), ("a-b", "a‐b"), ("한글", unicodedata.normalize("NFD", "한글")),
    ("Glacier", "Glaϲier"), ("dog", "ԁoɡ"), ("x", "  x "), ("ñ", "n​̃"), ("ﾎﾟ", "ポ"),
]
DIFFERENT = [
    ("Tolme", "Tôlmé"), ("Oven", "oven"), ("10²", "102"), ("H₂", "H2"), ("½", "1/2"), ("④", "4"), ("\U0001f469‍\U0001f680", "\U0001f469\U0001f680"),
    ("colour", "color"), ("a  b", "a b"), ("l", "1"), ("ß", "ss"),
]


def test_skeletons():
    for a, b in SAME:
        assert skeleton(a) == skeleton(b), (a, b)
    for a, b in DIFFERENT:
        assert skeleton(a) != skeleton(b), (a, b)


def test_unified_texts_are_equal_exactly_if_skeletons_are():
    texts = [t for pair in SAME + DIFFERENT for t in pair]
    for a, b in itertools.combinations(texts, 2):
        assert (unify(a)[0] == unify(b)[0]) == (skeleton(a) == skeleton(b)), (a, b)


def test_maps_lead_back():
    rng = random.Random(5)
    parts = ["a", "é", "é", "Ｘ", "​", " ", "ﬁ", "\U0001f600", "한", unicodedata.normalize("NFD", "글"), "с", " ", "­", "ọ̈"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        form, back = unify(text)
        at = 0
        for c in form:
            source = deltamap.to_source(back, at)
            assert 0 <= source < py_len(text)
            assert skeleton(unicodedata.normalize("NFC", c))[:1] in ("", *(skeleton(py_slice(text, source, source + 8)).lstrip(" ")[:1] or " "), skeleton(c)[:1])
            at += py_len(c)
        if form and form == text:
            assert back is None


NODES = "node_id long, sdt_id long, text string, delta_map string, look string"


def nodes(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], NODES)


def test_pairs_are_brute_force(spark):
    rng = random.Random(2)
    texts = [t for p in SAME + DIFFERENT for t in p] + ["", " ", "​", "same", "same"]
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), rng.choice(texts), None) for i in range(300)]
    rows += [(900, 1, None, None), (901, None, "Compass", None), (None, 1, "Compass", None)] + rows[:10]
    expected = set()
    good = [r for r in set(rows) if None not in r[:3]]
    for a, b in itertools.combinations(sorted(good), 2):
        if a[1] == b[1] and a[0] != b[0] and skeleton(a[2]) == skeleton(b[2]) and a[2].strip(" ") != b[2].strip(" "):
            expected.add((min(a[0], b[0]), max(a[0], b[0])))
    out = [(r.node_a, r.node_b) for r in lookalike_pairs(nodes(spark, rows)).collect()]
    assert len(out) == len(set(out)) and set(out) == expected and expected
    assert lookalike_pairs(nodes(spark, [])).count() == 0


def test_one_hot_spelling(spark):
    rows = [(i, 1, "Menu", None) for i in range(5000)] + [(9999, 1, "Мenu", None)]
    assert lookalike_pairs(nodes(spark, rows)).count() == 5000


def test_unified_column(spark):
    rows = [(1, 1, "Com​pass", "3 -2"), (2, 1, "plain", "0 -4"), (3, 1, None, None), (4, 1, "", ""), (5, 1, "  x", None), (6, 1, "ｆｕｌｌ", None)]
    out = {r.node_id: (r.unified_text, r.unified_delta_map) for r in unify_texts(nodes(spark, rows)).collect()}
    assert out[2] == ("plain", "0 -4") and out[3] == (None, None) and out[4] == ("", None) and out[5] == ("x", "0 -2") and out[6] == ("full", None)
    assert out[1][0] == "Compass" and [deltamap.to_source(out[1][1], p) for p in range(7)] == [0, 1, 2, 6, 7, 8, 9]


def test_the_public_table():
    table = lookalikes()
    assert len(table) > 2000 and all(k > "\x7f" and k != v for k, v in table.items())
    for a, b in [("s", "\uabaa"), ("O", "\u2c9e"), ("/", "\u2044"), ("/", "\u2215"), (":", "\u0589"), ("I", "\u0406"), ("l", "\u04cf"), ("c", "\u03f2"), ("S", "\u13da")]:
        assert skeleton(a) == skeleton(b), (a, b)
    # what a reader can tell apart: ASCII among itself, marks, digits, signs of currency, syllables
    for a, b in [("1", "l"), ("0", "O"), ("rn", "m"), ("\u0660", "."), ("e", "\u00e8"), ("\u30ed", "\u53e3"), ("ae", "\u00e6"), ("\u20ac", "\u0454")]:
        assert skeleton(a) != skeleton(b), (a, b)


def test_classes_and_spellings_say_what_pairs_say(spark):
    rng = random.Random(4)
    texts = [t for p in SAME + DIFFERENT for t in p] + ["", "same"]
    rows = [(i, rng.choice([1, 1, 2, 3]), rng.choice(texts), None) for i in range(250)]
    df = nodes(spark, rows + rows[:20] + [(900, 1, None, None), (None, 1, "Compass", None)])
    pairs = {(r.node_a, r.node_b) for r in lookalike_pairs(df).collect()}
    told = lookalike_classes(df).collect()
    links = {}
    for a, b in pairs:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    assert {r.node: r.links for r in told} == links and len(told) == len(links)
    expanded = set()
    for r in lookalike_spellings(df).collect():
        left = [x.node for x in told if (x.scope, x["class"], x.spelling) == (r.scope, r["class"], r.spelling_a)]
        right = [x.node for x in told if (x.scope, x["class"], x.spelling) == (r.scope, r["class"], r.spelling_b)]
        assert (min(left), len(left), min(right), len(right)) == (r.node_a, r.nodes_a, r.node_b, r.nodes_b)
        expanded |= {(min(a, b), max(a, b)) for a in left for b in right}
    assert expanded == pairs
    assert lookalike_classes(df.where("false")).count() == 0 and lookalike_spellings(df.where("false")).count() == 0
