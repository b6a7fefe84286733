import math
import random
import re

from pyspark.sql import functions as F

from arbordoc.llm import repetition as rp


def brute(text):
    """Letters and digits, one by one, by the definition."""
    tokens = [(m.start(), m.end(), m.group().casefold()) for m in re.finditer(r"[^\W_]+", text)]
    marked = [False] * len(tokens)
    words = [t[2] for t in tokens]
    for i in range(len(words) - 4):
        if any(words[j : j + 5] == words[i : i + 5] for j in range(i)):
            marked[i : i + 5] = [True] * 5
    for pattern in (rp._SENTENCE_END, re.compile(r"\n+")):
        edges = [0, *(m.start() for m in pattern.finditer(text)), len(text)]
        groups = [[k for k, t in enumerate(tokens) if a <= t[0] < b] for a, b in zip(edges, edges[1:])]
        keys = ["".join(words[k] for k in g) for g in groups]
        for n, g in enumerate(groups):
            if keys[n] and keys[n] in keys[:n]:
                for k in g:
                    marked[k] = True
    return sum(e - s for (s, e, _), m in zip(tokens, marked) if m), sum(e - s for s, e, _ in tokens)


def test_words_are_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(["one ", "two, ", "three ", "Four ", "ONE ", "five. ", "Six! ", "\n", "2.5 ", "\n\n"]) for _ in range(rng.randint(0, 60)))
        assert rp.repeated_units(text) == brute(text), text


def test_scripts_without_blanks():
    once = "灯台が港の近くで時計を数えた"
    assert rp.repeated_units(once)[0] == 0
    a, b = rp.repeated_units(once + "水車が" + once)
    assert (a, b) == (len(once), 2 * len(once) + 3)
    assert rp.repeated_units("灯台が港を" + "と" + "灯台が港を")[0] == 0
    assert rp.repeated_units("終わり。始まり。終わり。") == (3, 9)


def test_edges():
    assert rp.repeated_units("") == (0, 0) and rp.repeated_units("!!! ...") == (0, 0) and rp.repeated_units("İ" * 30)[1] == 30
    a, b = rp.repeated_units("spam " * 100_000)
    assert b == 400_000 and a == 399_996
    assert rp.repeated_units("Yes. Yes. No.") == (3, 8)


def test_bounds():
    assert rp.binomial_upper_bound(0, 0, 0.05) == 1 and rp.binomial_upper_bound(5, 5, 0.05) == 1
    assert abs(rp.binomial_upper_bound(0, 100, 0.05) - (1 - 0.05**0.01)) < 1e-9
    for bad, n, delta in ((3, 50, 0.05), (10, 200, 0.01)):
        p = rp.binomial_upper_bound(bad, n, delta)
        assert abs(sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(bad + 1)) - delta) < 1e-6


def test_cutoffs(spark):
    rng = random.Random(1)
    rows = [("en", rng.random() * 0.2, True) for _ in range(2000)] + [("en", 0.5 + rng.random() / 2, False) for _ in range(300)] + [("xx", 0.0, True)] * 5
    df = spark.createDataFrame(rows, "s string, x double, good boolean")
    out = rp.risk_controlled_cutoffs(df, "s", "x", "good", limit=0.05)
    assert out == {"en": 0.2}
    late = rp.risk_controlled_cutoffs(df, "s", "x", "good", limit=0.5)
    assert late["en"] < out["en"]


DOCS = "doc_id long, text string, lang string, total string"


def test_documents(spark):
    rows = [(1, "Buy the old boat right now today! " * 4, "en", "c"), (2, "One sentence only, and nothing more.", "EN-gb", "c"), (3, None, "en", "c"), (4, "", None, "c"),
            (5, "Gleich. Gleich. Gleich.", "  de ", "c"), (None, "x x x x x x x x x x", "en", "c"), (6, "灯台が港の近くで時計を数えた" * 3, "12", "c")]
    df = spark.createDataFrame(rows + rows[:2], DOCS)
    out = {r.doc_id: r.stratum for r in rp.repetitive_documents(df).collect()}
    assert out == {1: "en/3", 5: "de/2", 6: "und/2"} and rp.repetitive_documents(df).count() == 3
    shares = {r.doc_id: r.repeated_share for r in rp.repetition(df.drop("total")).collect()}
    assert shares[3] == 0 and shares[4] == 0 and shares[2] == 0 and abs(shares[5] - 2 / 3) < 1e-9
    assert rp.repetitive_documents(df.where("false")).count() == 0


def test_every_repetitive_document_is_found(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(600):
        fresh = [rng.choice(words) for _ in range(60)]
        again = fresh[: rng.choice([0, 0, 0, 10, 20, 30, 40, 60])]
        rows.append((i, " ".join(fresh + again), rng.choice(["en", "de"]), "c"))
    out = {r.doc_id for r in rp.repetitive_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {r[0] for r in rows if 3 * brute(r[1])[0] >= brute(r[1])[1]}


def test_the_certified_cutoffs_decide(spark):
    """The score is not the repeated share, and what is rejected depends on the limit and on the labels."""
    rng = random.Random(12)
    rows = []
    for i in range(900):
        few = [f"w{k} v{k}" for k in range(rng.choice([10, 200, 400, 800]))]  # pairs of words recur, phrases do not
        rows.append((i, " ".join(rng.choice(few) for _ in range(50)), "en", "c"))
    truth = set()
    for i in range(900, 960):
        fresh = [f"x{i}y{k}" for k in range(60)]
        rows.append((i, " ".join(fresh + fresh[:32]), "en", "c"))
        truth.add(i)
    df = spark.createDataFrame(rows, DOCS)
    found = {limit: {r.doc_id for r in rp.repetitive_documents(df, limit=limit).collect()} for limit in (0.02, 0.6)}
    assert found[0.6] == truth and found[0.02] < truth
    cutoffs = {r.cutoff for r in rp.repetitive_documents(df, limit=0.6).collect()}
    assert all(c > 0 for c in cutoffs)
    # labels of a stranger's hand: what is good there moves the cutoffs
    labels = spark.createDataFrame([(i, i < 900) for i in range(960)], "doc_id long, good boolean")
    assert {r.doc_id for r in rp.repetitive_documents(df, limit=0.6, labels=labels).collect()} == truth
    none = labels.where("doc_id < 0")
    assert {r.doc_id for r in rp.repetitive_documents(df, labels=none).collect()} == truth and {r.cutoff for r in rp.repetitive_documents(df, labels=none).collect()} == {0.0}


def test_the_score_follows_the_repeated_share(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["one", "Two,", "three", "ONE", "five.", "Six!", "\n", "2.5"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",), ("!?",)], "text string")
    for r in df.select("text", rp.seen_before(F.col("text")).alias("s")).collect():
        repeated, total = rp.repeated_units(r.text or "")
        # the pair at a phrase's edge is new: of five words four pairs are seen
        assert r.s >= (0.5 * repeated / total if total else 0) - 1e-9
    assert df.select(rp.seen_before(F.col("text")).alias("s")).where("s IS NULL OR s < 0 OR s > 1").count() == 0
