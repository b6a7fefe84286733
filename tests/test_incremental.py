import random

import pytest
from pyspark.sql import functions as F

from arbordoc.operators import incremental as inc

PLAN = inc.Feed(key="k", record="id", arrived="at", content=("lower(h)", "v"), rank=("made", "v", "-id"), usable="h IS NOT NULL")
SCHEMA = "id long, k long, made int, v int, h string, at timestamp, h2 string"


def feed(spark, rows):
    df = spark.createDataFrame([(*r[:5], r[5]) for r in rows], "id long, k long, made int, v int, h string, sec long")
    return df.withColumn("at", F.timestamp_seconds("sec")).withColumn("hash", F.lit("clash")).withColumn("key", F.lit(1)).drop("sec")


def brute(rows, runs):
    out, before = [], {}
    for number, sec in runs:
        now = {}
        for i, k, made, v, h, at in rows:
            if at is not None and k is not None and at <= sec and h is not None:
                rank = (made is not None, made or 0, v is not None, v or 0, -i)
                if k not in now or rank > now[k][0]:
                    now[k] = (rank, i, h.lower(), v)
        out += [(number, x[1]) for k, x in now.items() if k not in before or before[k][2:] != x[2:]]
        before = now
    return sorted(out)


def rows_of(rng, n):
    rows = [(i, rng.choice([1, 1, 1, 2, 3, 4, 5, None]), rng.choice([None, *range(6)]), rng.choice([None, 1, 2]), rng.choice(["aa", "AA", "bb", "cc", None]), rng.randint(0, 100)) for i in range(n)]
    return rows + rows[:5]


@pytest.mark.parametrize("seed", range(3))
def test_replay_is_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = rows_of(rng, 120)
    runs = [(n, s) for n, s in zip(range(10, 22), sorted(rng.sample(range(110), 12)))]
    status = {n: rng.choice(["succeeded", "succeeded", "failed", "killed"]) for n, _ in runs}
    table = spark.createDataFrame([(n, s, status[n]) for n, s in runs], "run_id int, sec long, status string").withColumn("started_at", F.timestamp_seconds("sec"))
    out = inc.replay(feed(spark, rows), PLAN, table, str(tmp_path / "state"), batch=5)
    assert sorted((r.run, r.record) for r in out.collect()) == brute(rows, [r for r in runs if status[r[0]] == "succeeded"])


def test_a_crash_loses_and_repeats_nothing(spark, tmp_path):
    rows = rows_of(random.Random(7), 80)
    store = inc.StateStore(spark, str(tmp_path / "state"))
    runs = [(1, 30), (2, 60), (3, 90)]
    micros = [(n, s * 1_000_000) for n, s in runs]
    got = []
    for due in micros:
        with pytest.raises(RuntimeError):
            inc.advance(store, feed(spark, rows), PLAN, [due], crash="written")
        got += [(r.run, r.record) for r in inc.advance(store, feed(spark, rows), PLAN, [due]).collect()]
        assert inc.advance(store, feed(spark, rows), PLAN, [due]) is None
    assert sorted(got) == brute(rows, runs)
    assert store.current()[0] == 3


def test_only_one_of_two_commits(spark, tmp_path):
    store = inc.StateStore(spark, str(tmp_path / "state"))
    store.commit(store.prepare(), {"from": 0, "seen": 1, "runs": [1]})
    with pytest.raises(RuntimeError):
        store.commit(store.prepare(), {"from": 0, "seen": 1, "runs": [1]})


def test_nothing_to_do(spark, tmp_path):
    table = spark.createDataFrame([], "run_id int, started_at timestamp, status string")
    assert inc.replay(feed(spark, rows_of(random.Random(1), 6)), PLAN, table, str(tmp_path / "a")).count() == 0
    table = spark.createDataFrame([(1, "succeeded")], "run_id int, status string").withColumn("started_at", F.timestamp_seconds(F.lit(50)))
    assert inc.replay(feed(spark, [(1, 1, 1, 1, "a", 1)]).where("false"), PLAN, table, str(tmp_path / "b")).count() == 0


def test_hash(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "abc"), ("", "abc")], "x string, y string")
    assert df.select(inc.content_hash("x", "y").alias("h")).distinct().count() == 4


def test_a_record_that_lands_late_is_found(spark, tmp_path):
    store = inc.StateStore(spark, str(tmp_path / "state"))
    early, late = [(1, 1, 1, 1, "aa", 10), (2, 2, 1, 1, "bb", 10)], (3, 3, 1, 1, "cc", 5)
    assert {r.record for r in inc.advance(store, feed(spark, early), PLAN, [(1, 20_000_000)]).collect()} == {1, 2}
    assert [r.record for r in inc.advance(store, feed(spark, [*early, late]), PLAN, [(2, 30_000_000)]).collect()] == [3]
    # a promise that nothing lands later than that leaves it out, and keys that the feed no longer has stay known
    older = (4, 4, 1, 1, "dd", 5)
    assert inc.advance(store, feed(spark, [older]), PLAN, [(3, 40_000_000)], late_seconds=1).count() == 0
    assert inc.advance(store, feed(spark, early), PLAN, [(4, 50_000_000)]).count() == 0


def test_old_states_and_dead_attempts_are_removed(spark, tmp_path):
    folder = tmp_path / "state"
    store = inc.StateStore(spark, str(folder))
    rows = rows_of(random.Random(3), 40)
    with pytest.raises(RuntimeError):
        inc.advance(store, feed(spark, rows), PLAN, [(1, 10_000_000)], crash="written")
    for n in range(1, 5):
        inc.advance(store, feed(spark, rows), PLAN, [(n, n * 10_000_000)])
    assert len(list(folder.glob("attempt-*/state"))) == 3 and len(list(folder.glob("attempt-*/changed"))) == 5
    assert store.drop_attempts(3600) == 0 and store.drop_attempts(-5) == 1
    assert len(list(folder.glob("attempt-*/state"))) == 2 and store.read().count() > 0


def test_a_number_is_taken_once(spark, tmp_path):
    store = inc.StateStore(spark, str(tmp_path / "state"))
    (tmp_path / "state" / "a").write_text("1")
    (tmp_path / "state" / "b").write_text("2")
    assert store._claim(f"{store.folder}/a", f"{store.folder}/c") and not store._claim(f"{store.folder}/b", f"{store.folder}/c")
    assert (tmp_path / "state" / "c").read_text() == "1"
