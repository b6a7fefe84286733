import random

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from arbordoc.functions.utf16 import py_len, py_slice
from arbordoc.llm.split import _cut_points, split_chunks, split_oversized, split_text


def check(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    limit = max(limit, 2)
    overlap = max(0, min(overlap, limit // 2 - 1))
    assert pieces[0][0] == 0 and pieces[-1][1] == py_len(text)
    assert all(py_len(p) == b - a <= limit and p == py_slice(text, a, b) for a, b, p in pieces)
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert b - c in (overlap, overlap + 1) and b < d and a < c
    if len(pieces) == 1:
        assert py_len(text) <= limit
    return pieces


@settings(max_examples=600, deadline=None, derandomize=True)
@example("\U0001f600\U0001f600\U0001f600.;\u0301", 4, 1)
@given(st.text(alphabet="ab .\n,;é\U0001f600́‍", max_size=400), st.integers(4, 60), st.integers(0, 30))
def test_any_text(text, limit, overlap):
    check(text, limit, overlap)


def test_balanced_and_natural():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", ".", ","]) for _ in range(3000))
    pieces = check(text, 1000, 100)
    least = -(-(len(text) - 100) // 900)
    assert len(pieces) <= least + 1
    sizes = [b - a for a, b, _ in pieces]
    assert min(sizes) > 0.6 * max(sizes)
    assert all(p[-1] == " " for _, _, p in pieces[:-1])


def test_no_boundaries_and_surrogates():
    assert [len(p) for _, _, p in check("x" * 100, 30, 5)] and check("\U0001f600" * 50, 11, 3)
    assert check("", 5, 1) == [(0, 0, "")]
    check("x" * 1_000_00, 1000, 999)


def test_strongest_boundary_wins():
    text = "a" * 40 + " " + "b" * 10 + "\n" + "c" * 49
    (_, first, _), *_ = split_text(text, 60, 0)
    assert first == 52


@settings(max_examples=400, deadline=None, derandomize=True)
@given(st.text(alphabet="abcdefghij .\n", max_size=600), st.integers(20, 80), st.integers(0, 15))
@example("x" * 181 + "\n" + "y" * 61, 240, 24)
@example("word " * 35 + "x" * 160 + " word" * 40, 100, 20)
def test_runs_are_cut_only_where_they_have_no_boundary(text, limit, overlap):
    pieces = check(text, limit, overlap)
    overlap = min(overlap, limit // 2 - 1)
    natural = set(_cut_points(text)[0].tolist())
    before = 0
    for a, b, _ in pieces[:-1]:
        least = max(before, a + overlap) + 1
        assert b in natural or not natural & set(range(least, a + limit + 1))
        before = b
    # and no run more often than its length takes
    ends = [0, *sorted(natural), len(text)]
    runs = [(q - p - (overlap if p == 0 else 0), limit - overlap) for p, q in zip(ends, ends[1:])]
    assert sum(b not in natural for _, b, _ in pieces[:-1]) <= sum(max(0, -(-n // room) - 1) for n, room in runs)


CHUNK = "chunk_id long, sdt_id long, processor_type string, start_block_index int, end_block_index int, text string, end_unit string"


def test_tables(spark):
    blocks = [(1, 0, "heading", "Title", None), (1, 1, "paragraph", "x" * 50, None), (1, 2, "paragraph", "gone", "excluded"), (1, 3, "paragraph", "y" * 60, None), (1, 4, "paragraph", "", None)]
    blocks = spark.createDataFrame(blocks + blocks[:2], "sdt_id long, block_index int, block_type string, text string, flow_class string")
    text = "x" * 50 + "\n" + "y" * 60
    rows = [(7, 1, "pdf", 0, 4, text, "e"), (7, 1, "pdf", 0, 4, text, "e"), (8, 1, "pdf", 0, 4, "short", "e"), (9, 1, "other", 0, 4, text, "e"), (10, 1, None, 0, 4, text, "e"),
            (11, 1, "pdf", 0, 4, None, "e"), (12, 2, "pdf", 5, 6, "z" * 100, "e"), (13, 1, "pdf", 0, 4, "", "e")]
    chunks = spark.createDataFrame(rows, CHUNK)
    limits = spark.createDataFrame([("pdf", 60, 10), ("pdf", 70, 10), ("none", None, 1)], "processor_type string, max_units int, overlap_units int")
    found = {r.chunk_id for r in split_oversized(chunks, limits).collect()}
    assert found == {7, 12}
    out = split_chunks(chunks, limits, blocks).orderBy("chunk_id", "piece_index").collect()
    spans = [(r.chunk_id, r.start_unit, r.end_unit, r.start_block_index, r.end_block_index) for r in out]
    assert spans[0][:3] == (7, 0, 51) and spans[0][3:] == (1, 1) and spans[1][3:] == (1, 3) and spans[-1][3:] == (5, 6)
    assert "".join(o.text if o.piece_index == 0 else o.text[10:] for o in out if o.chunk_id == 7) == text
    assert split_oversized(chunks.where("false"), limits).count() == 0 and split_chunks(chunks, limits.where("false"), blocks).count() == 0
    assert split_chunks(chunks, limits, blocks.where("false")).count() == len(out)


@pytest.mark.parametrize("overlap", [None, 0])
def test_null_overlap(spark, overlap):
    chunks = spark.createDataFrame([(1, 1, "pdf", 0, 0, "word " * 30, "e")], CHUNK)
    limits = spark.createDataFrame([("pdf", 60, overlap)], "processor_type string, max_units int, overlap_units int")
    assert "".join(r.text for r in split_oversized(chunks, limits).orderBy("piece_index").collect()) == "word " * 30
