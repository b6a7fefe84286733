import random

import pytest
from pyspark.sql import functions as F

from arbordoc.llm import mixing, packing, tokens

TEXT = "The lighthouse counted every boat before the harbour closed. "


@pytest.mark.parametrize("seed", range(5))
def test_bins(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 100, 512])
    sizes = [rng.randint(1, capacity) if rng.random() < 0.3 else rng.randint(1, max(1, capacity // 4)) for _ in range(rng.choice([0, 1, 50, 2000]))]
    bins = packing.best_two_fit(sizes, capacity)
    assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= capacity for b in bins)
    if len(sizes) > 1000:
        assert len(bins) <= 1.02 * -(-sum(sizes) // capacity) + 1


def test_exchange_fills_gaps():
    # greedily 6 + 3 leaves 1 of 10; two documents of 2 fill what 3 left
    bins = packing.best_two_fit([6, 3, 2, 2], 10)
    assert sorted(map(sorted, bins)) in ([[2, 2, 6], [3]], [[2, 2], [3, 6]]) and max(map(sum, bins)) == 10


def posts(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, capacity string, size int")


def test_pack_tables(spark):
    rng = random.Random(3)
    rows = [(i, TEXT * rng.randint(1, 40), "a") for i in range(200)]
    rows += rows[:5] + [(900, "", "a"), (901, None, "a"), (None, TEXT, "a"), (902, TEXT * 200, "a"), (903, "\U0001f600" * 30, None)]
    caps = spark.createDataFrame([("s", 64), ("l", 512), ("l", 600), ("bad", None), ("zero", 0), (None, 5)], "capacity_name string, capacity_tokens int")
    out = packing.pack(posts(spark, rows), caps, shard_documents=60).collect()
    enc = tokens.encoding(tokens.RANKS)
    size = {i: len(enc.encode_ordinary(t)) for i, t, _ in rows if i is not None and t}
    for name, cap in (("s", 64), ("l", 512)):
        mine = [r for r in out if r.capacity_name == name]
        fill: dict = {}
        pieces: dict = {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
            pieces.setdefault(r.doc_id, []).append((r.piece, r.first_token, r.tokens))
        assert max(fill.values()) <= cap and set(pieces) == set(size)
        for doc, parts in pieces.items():
            parts.sort()
            assert sum(p[2] for p in parts) == size[doc] and (len(parts) == 1 or size[doc] > cap)
            assert all(p[1] == k * cap for k, p in enumerate(parts))
    assert {r.capacity_name for r in out} == {"s", "l"}
    report = {r.capacity_name: r for r in packing.fill_report(packing.pack(posts(spark, rows), caps), caps.where("capacity_tokens > 0")).collect()}
    assert report["s"].used_share > 0.9 and report["s"].containers >= report["s"].least_containers
    assert packing.pack(posts(spark, []), caps).count() == 0 and packing.pack(posts(spark, rows), caps.where("false")).count() == 0


def test_mixture(spark):
    rng = random.Random(5)
    rows = []
    for s, n in (("Big", 900), ("mid ", 300), ("small", 40), ("none", 50), (None, 5)):
        rows += [(len(rows) + i, TEXT * rng.randint(1, 12), s if rng.random() < 0.8 or s is None else s.upper()) for i in range(n)]
    rows += rows[:20] + [(9001, "", "big"), (9002, None, "big"), (None, TEXT, "big")]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), (None, 0.4, 1), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    # a mixture that the smallest source can fill its share of
    enc = tokens.encoding(tokens.RANKS)
    size = {i: (s.strip().lower(), len(enc.encode_ordinary(t))) for i, t, s in rows if i is not None and t and s}
    have = {s: sum(n for x, n in size.values() if x == s) for s in ("big", "mid", "small")}
    total = 3 * have["small"] * 5
    mixed = mixing.mixture(posts(spark, rows), targets, total_tokens=total, slot_tokens=256, bucket=40).cache()
    report = {r.source: r for r in mixing.share_report(mixed, targets).collect()}
    assert all(abs(r.actual_share - r.target_share) < 0.01 for r in report.values()) and report["small"].most_uses <= 3 and report["big"].most_uses == 1
    per_use = mixed.groupBy("doc_id", "use").count()
    assert per_use.where("count > 1").count() == 0
    names = dict((i, s.strip().lower()) for i, _, s in rows if i is not None and s)
    assert all(names[r.doc_id] == r.source for r in mixed.collect())
    # every stretch of the mixture has nearly the target shares
    last = mixed.where("source = 'small'").agg(F.max("slot")).first()[0]
    half = {r.source: r.t for r in mixed.where(F.col("slot") < last // 2).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    assert abs(half["big"] / sum(half.values()) - 0.5) < 0.06
    again = mixing.mixture(posts(spark, rows), targets, total_tokens=total, slot_tokens=256, bucket=40)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))
    # by default all there is: the small source stops at its cap, the others share out the rest in proportion
    whole = {r.source: r for r in mixing.share_report(mixing.mixture(posts(spark, rows), targets, slot_tokens=256, bucket=40), targets).collect()}
    assert whole["small"].tokens == 3 * have["small"] and whole["small"].most_uses == 3 and whole["mid"].most_uses == 2
    assert abs(whole["big"].tokens / whole["mid"].tokens - 5 / 3) < 0.02 and abs(sum(r.tokens for r in whole.values()) / sum(have.values()) - 1) < 0.01
    assert mixing.mixture(posts(spark, []), targets).count() == 0 and mixing.mixture(posts(spark, rows), targets.where("false")).count() == 0


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(0, 5), i, rng.randint(1, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, b int, i int, v int")
    out = {r.i: r.s for r in mixing.running(df, "g", "b", ["i"], F.col("v"), "s").collect()}
    for g, b, i, _ in rows:
        assert out[i] == sum(v for h, c, j, v in rows if h == g and (c, j) < (b, i))


def test_fill_up():
    assert mixing.fill_up([100, 100, 100], [0.5, 0.3, 0.2], 100) == [50, 30, 20]
    assert mixing.fill_up([1000, 1000, 5], [0.5, 0.3, 0.2], 100) == [59, 35, 5]
    assert mixing.fill_up([10, 10, 5], [0.5, 0.3, 0.2], 100) == [10, 10, 5] and mixing.fill_up([], [], 0) == []


def test_pieces_of_tiny_capacities_are_spread(spark):
    caps = spark.createDataFrame([("tiny", 2), ("wide", 100_000)], "capacity_name string, capacity_tokens int")
    out = packing.pack(posts(spark, [(i, TEXT * 40, "a") for i in range(20)]), caps, shard_documents=500).collect()
    shards = {n: len({r.container_id >> 32 for r in out if r.capacity_name == n}) for n in ("tiny", "wide")}
    pieces = sum(r.capacity_name == "tiny" for r in out)
    assert shards["wide"] == 1 and shards["tiny"] == -(-pieces // 500) > 5
