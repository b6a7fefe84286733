"""Processing only new or changed records, run by run, with state that survives failures.

The state of a feed is one row per key: the record that is current, its content hash and what decides
between records.  It lives in a folder as numbered versions, each a complete Parquet table, and a small
pointer that names the version in force.  A run hashes the records it sees, reduces them to the current
one of each key, joins these with the state to select the new and the changed, and writes its changes and
the next version aside; putting the new pointer in place is the one atomic step.  A run that dies before
that step leaves the old version in force, so the next one finds the same changes again: nothing is
skipped and nothing is repeated.  A record is told by its key and hash, not by when it came: one that
turns up late, with an older arrival, is found like any other.

Several runs that are due can be processed together (:func:`advance`): each record is given to the first
run that sees it, records are pre-aggregated by key and run, and the changes of each run come out with
its number.  The result is the same as processing the runs one by one.
"""

from __future__ import annotations

import itertools
import json
import os
import uuid
from urllib.parse import urlparse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def content_hash(*columns: Column | str) -> Column:
    """A 128-bit digest over columns; NULL differs from '' and values do not run together."""
    parts = [F.coalesce(F.concat(F.lit("="), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.to_json(F.array(*parts)))


@dataclass(frozen=True)
class Feed:
    """How a feed is read: its key, its content, and which of a key's records is current.

    ``rank`` names expressions of which the greatest tuple is current; it must order any two records of
    a key that differ.  ``arrived`` decides which run sees a record first.  Records with a NULL key or
    arrival, or for which ``usable`` is not true, do not exist for any run.
    """

    key: str
    record: str
    arrived: str
    content: tuple[str, ...]
    rank: tuple[str, ...]
    usable: str = "true"

    def records(self, feed: DataFrame) -> DataFrame:
        """(key, arrived, rank, record, hash) of the records that exist."""
        rank = F.struct(*(F.expr(x).alias(f"r{i}") for i, x in enumerate(self.rank)))
        return feed.where(self.usable).where(F.col(self.key).isNotNull() & F.col(self.arrived).isNotNull()).select(
            F.col(self.key).alias("key"),
            F.col(self.arrived).alias("arrived"),
            rank.alias("rank"),
            F.col(self.record).alias("record"),
            content_hash(*(F.expr(x) for x in self.content)).alias("hash"),
        )


class StateStore:
    """Numbered state versions in a folder, and the pointer to the one in force."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def _pointers(self) -> list[tuple[int, str]]:
        found = []
        for status in self._fs.listStatus(self._path(self.folder)):
            name = status.getPath().getName()
            if name.startswith("pointer-"):
                number, _, token = name[len("pointer-") :].partition("-")
                found.append((int(number), token))
        return sorted(found)

    def current(self) -> tuple[int, dict] | None:
        """(version, what was said at its commit), or None before the first commit."""
        pointers = self._pointers()
        if not pointers:
            return None
        number, _ = pointers[-1]
        path = self._path(f"{self.folder}/pointer-{number}")
        stream = self._fs.open(path)
        try:
            raw = bytes(stream.readAllBytes())
        finally:
            stream.close()
        return number, json.loads(raw.decode())

    def read(self) -> DataFrame | None:
        now = self.current()
        return self.spark.read.parquet(f"{self.folder}/{now[1]['data']}/state") if now else None

    def prepare(self) -> str:
        """A fresh folder for one attempt's output; it means nothing until it is committed."""
        return f"attempt-{uuid.uuid4().hex}"

    def commit(self, attempt: str, said: dict) -> int:
        """Puts an attempt's state in force, and removes the states before the one it replaces.

        The pointer is written under another name and then given its number, in one step that fails if the
        number is taken: a hard link on local disks, a rename that does not replace elsewhere.  So of two
        runs that started from one version only one succeeds.  The folder must be on a file system where
        such a rename is atomic, as on HDFS; bare object stores have none.
        """
        now = self.current()
        number = (now[0] if now else 0) + 1
        if said.get("from", number - 1) != number - 1:
            raise RuntimeError("another run has committed since this one read its state")
        aside, target = f"{self.folder}/.{attempt}", f"{self.folder}/pointer-{number}"
        out = self._fs.create(self._path(aside), True)
        try:
            out.write(bytearray(json.dumps({**said, "data": attempt}).encode()))
        finally:
            out.close()
        if not self._claim(aside, target):
            raise RuntimeError("another run has committed since this one read its state")
        if number > 2:
            self._drop_state(number - 2)
        return number

    def _claim(self, aside: str, target: str) -> bool:
        """Gives a file its final name unless that is taken."""
        if self._fs.getScheme() == "file":
            try:
                os.link(urlparse(aside).path, urlparse(target).path)
            except FileExistsError:
                return False
            self._fs.delete(self._path(aside), False)
            return True
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._path(aside), self._path(target), none)
        except Exception:
            if self._fs.exists(self._path(target)):
                return False
            raise
        return True

    def _drop_state(self, number: int) -> None:
        """Removes the state of a version that nobody reads any more; its changes stay."""
        stream = self._fs.open(self._path(f"{self.folder}/pointer-{number}"))
        try:
            said = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        self._fs.delete(self._path(self.path(said["data"], "state")), True)

    def drop_attempts(self, older_than_seconds: float) -> int:
        """Removes what runs that died have left, if it is older than any run may take; returns how many attempts."""
        import time

        kept = set()
        for number, _ in self._pointers():
            stream = self._fs.open(self._path(f"{self.folder}/pointer-{number}"))
            try:
                kept.add(json.loads(bytes(stream.readAllBytes()).decode())["data"])
            finally:
                stream.close()
        dropped = 0
        for status in self._fs.listStatus(self._path(self.folder)):
            name = status.getPath().getName()
            if name.lstrip(".").startswith("attempt-") and name.lstrip(".") not in kept and status.getModificationTime() / 1000 < time.time() - older_than_seconds:
                self._fs.delete(status.getPath(), True)
                dropped += not name.startswith(".")
        return dropped

    def path(self, attempt: str, what: str) -> str:
        return f"{self.folder}/{attempt}/{what}"


def changes(records: DataFrame, state: DataFrame | None, runs: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """(changed, next state) after runs [(number, instant it sees, in microseconds of the epoch)], ascending by instant.

    ``changed`` has (run, key, record, hash): for each run, the keys whose current record's hash differs
    from that at the run before, or that had none.  The next state holds every key's current record after
    the last run; keys that the records no longer have keep theirs.

    A key's records are first reduced to the greatest of each run, by a pre-aggregated maximum, and these
    joined with the state, so that at most one row per key and run is left to put in order: a key that owns
    a third of all records is no larger than any other there.
    """
    instants = F.array(*(_instant(t) for _, t in runs))
    at = F.size(F.filter(instants, lambda t: t < F.col("arrived")))
    best = F.struct("rank", "record", "hash")
    fresh = records.where(F.col("arrived") <= _instant(runs[-1][1])).select("key", at.alias("run_at"), best.alias("best"))
    by_run = fresh.groupBy("key", "run_at").agg(F.max("best").alias("best"))
    if state is None:
        joined = by_run.withColumn("old", F.lit(None).cast(by_run.schema["best"].dataType))
    else:
        joined = by_run.join(state.select("key", best.alias("old")), "key", "full_outer")
    order = Window.partitionBy("key").orderBy("run_at")
    told = joined.withColumn("now", F.greatest("old", F.max("best").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    told = told.withColumn("before", F.coalesce(F.lag("now").over(order), "old")).withColumn("next_run", F.lead("run_at").over(order))
    differs = F.col("before").isNull() | (F.col("before.hash") != F.col("now.hash"))
    numbers = F.array(*(F.lit(n) for n, _ in runs))
    changed = told.where(F.col("run_at").isNotNull() & differs).select(
        F.get(numbers, F.col("run_at")).alias("run"), "key", F.col("now.record").alias("record"), F.col("now.hash").alias("hash")
    )
    return changed, told.where("next_run IS NULL").select("key", "now.rank", "now.record", "now.hash")


def advance(
    store: StateStore, feed: DataFrame, plan: Feed, runs: list[tuple[int, int]], crash: str | None = None, late_seconds: int | None = None
) -> DataFrame | None:
    """Processes the runs that are due, and returns their changes (run, key, record, hash), None if no run is due.

    Runs at or before the last committed one are left out.  Changes are written with the state version they
    belong to, before it is committed, and read from there: whoever reads them sees all or nothing of a
    commit.  All records that the runs see are compared with the state, however long they have been there;
    ``late_seconds`` may promise that none turns up later than that after its arrival, so that older ones
    need not be read.  ``crash`` ('written') stops before the commit, for tests.
    """
    now = store.current()
    since = now[1]["seen"] if now else None
    due = sorted((t, n) for n, t in runs if since is None or t > since)
    if not due:
        return None
    records = plan.records(feed)
    if now and late_seconds is not None:
        records = records.where(F.col("arrived") > _instant(since - late_seconds * 1_000_000))
    changed, state = changes(records, store.read(), [(n, t) for t, n in due])
    attempt = store.prepare()
    changed.write.parquet(store.path(attempt, "changed"))
    state.write.parquet(store.path(attempt, "state"))
    if crash == "written":
        raise RuntimeError("stopped before the commit")
    store.commit(attempt, {"from": now[0] if now else 0, "seen": due[-1][0], "runs": [n for _, n in due]})
    return store.spark.read.parquet(store.path(attempt, "changed"))


def _instant(micros: int) -> Column:
    """A constant, so that a filter on it reaches the scan."""
    return F.timestamp_micros(F.lit(micros).cast("bigint"))


def replay(
    feed: DataFrame, plan: Feed, runs: DataFrame, folder: str, number: str = "run_id", started: str = "started_at",
    succeeded: str = "status = 'succeeded'", batch: int = 128,
) -> DataFrame:
    """The changes of every run that succeeded, by advancing a state from nothing in ``folder``, ``batch`` runs at a time.

    ``runs`` has one row per run.  Its succeeded rows pass through the driver a batch at a time (two values
    each), in order; a batch bounds how many of them a task looks through per record.  A run that did not
    succeed leaves nothing behind and so is not looked at.
    """
    rows = runs.where(succeeded).where(F.col(started).isNotNull() & F.col(number).isNotNull()).select(F.unix_micros(started).alias("t"), F.col(number).alias("n")).distinct()
    store = StateStore(feed.sparkSession, folder)
    waiting = rows.orderBy("t", "n").toLocalIterator()
    done = []
    while part := [(r["n"], r["t"]) for r in itertools.islice(waiting, batch)]:
        changed = advance(store, feed, plan, part)
        done += changed.inputFiles() if changed is not None else []
    if not done:
        return plan.records(feed).where("false").select(F.lit(None).cast("int").alias("run"), "key", "record", "hash")
    return feed.sparkSession.read.parquet(*done)
