"""Problem 6: filling containers of fixed capacity, by best-two-fit.

A bin is filled greedily with the largest document that fits, again and again; then its smallest
document is taken out, and if two documents that are not packed yet fill the widened gap more tightly,
they take its place.  The exchange is repeated until it gains nothing.

Documents are dealt to shards by a hash of their key, and each shard is packed by one task.  A shard holds
a bounded number of tokens, so its work does not grow with the corpus, and wastes at most the unfilled
rest of its last bins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import cut
from .tokens import RANKS, token_count

#: Tokens that a shard holds on average, and documents (or pieces of them) that it holds on average, whichever is reached first.
SHARD_TOKENS = 4_000_000
SHARD_DOCUMENTS = 20_000
#: Capacities are a control table, read by the driver; more of them are an error.
MOST_CAPACITIES = 1_000


class _Pool:
    """Sizes not packed yet, each with the number of documents of that size."""

    def __init__(self, sizes):
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.sizes = sorted(self.count)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            del self.count[size]
            del self.sizes[bisect_left(self.sizes, size)]

    def put(self, size: int) -> None:
        if size in self.count:
            self.count[size] += 1
        else:
            self.count[size] = 1
            insort(self.sizes, size)

    def largest(self, most: int) -> int | None:
        k = bisect_right(self.sizes, most)
        return self.sizes[k - 1] if k else None

    def two(self, most: int, more_than: int) -> tuple[int, int] | None:
        """The two sizes with the greatest sum in (more_than, most]."""
        best, pair = more_than, None
        low, high = 0, bisect_right(self.sizes, most) - 1
        while low <= high:
            a, b = self.sizes[low], self.sizes[high]
            if a + b > most:
                high -= 1
                continue
            if a + b > best and (low != high or self.count[a] > 1):
                best, pair = a + b, (a, b)
                if best == most:
                    break
            low += 1
        return pair


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """The sizes, each at most the capacity and at least 1, as bins."""
    pool = _Pool(sizes)
    bins = []
    while pool.sizes:
        packed: list[int] = []
        gap = capacity
        while (size := pool.largest(gap)) is not None:
            pool.take(size)
            packed.append(size)
            gap -= size
        while gap and len(packed) > 0:
            smallest = packed[-1]
            pair = pool.two(gap + smallest, smallest)
            if pair is None:
                break
            packed.pop()
            pool.put(smallest)
            for size in pair:
                pool.take(size)
                insort(packed, size, key=lambda x: -x)
            gap += smallest - sum(pair)
            while gap and (size := pool.largest(gap)) is not None:
                pool.take(size)
                insort(packed, size, key=lambda x: -x)
                gap -= size
        bins.append(packed)
    return bins


_PACKED = (
    T.StructType()
    .add("capacity_name", T.StringType())
    .add("container_id", T.LongType())
    .add("position", T.IntegerType())
    .add("doc_id", T.LongType())
    .add("piece", T.IntegerType())
    .add("first_token", T.LongType())
    .add("tokens", T.LongType())
)


def _pack_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    name, shard = key
    capacity = int(pdf["capacity"].iloc[0])
    waiting: dict[int, list] = {}
    for doc, piece, first, tokens in sorted(zip(pdf["doc_id"], pdf["piece"], pdf["first_token"], pdf["tokens"]), reverse=True):
        waiting.setdefault(int(tokens), []).append((int(doc), int(piece), int(first)))
    rows = []
    for number, packed in enumerate(best_two_fit([int(t) for t in pdf["tokens"]], capacity)):
        for position, size in enumerate(packed):
            doc, piece, first = waiting[size].pop()
            rows.append((name, (int(shard) << 32) + number, position, doc, piece, first, size))
    return pd.DataFrame(rows, columns=_PACKED.names)


def pack(
    documents: DataFrame, capacities: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str = RANKS,
    shard_tokens: int = SHARD_TOKENS, shard_documents: int = SHARD_DOCUMENTS,
) -> DataFrame:
    """(capacity_name, container_id, position, doc_id, piece, first_token, tokens): every document in a container of each capacity.

    A document that exceeds the capacity is cut in pieces of the capacity, the last one shorter; no other
    is.  Documents without tokens and NULL keys have no place; of unlike rows of a key one counts, the
    same one whatever the order of rows.  Capacities that are NULL or below 1 get no containers; of several
    capacities of a name the least counts.  Tokens are counted where the texts are, so no text is shuffled.
    """
    sized = (
        documents.where(F.col(key).isNotNull() & (F.col(text) != ""))
        .select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("digest"), token_count(F.col(text), ranks_path).alias("size"))
        .groupBy("doc_id").agg(F.min(F.struct("digest", "size")).alias("one"))
        .select("doc_id", "one.size").where("size > 0")
    )
    sized = cut(sized)
    bounds = capacities.where("capacity_tokens >= 1 AND capacity_name IS NOT NULL").groupBy("capacity_name").agg(F.min("capacity_tokens").alias("capacity"))
    named = sorted((r["capacity_name"], r["capacity"]) for r in bounds.limit(MOST_CAPACITIES + 1).collect())
    if len(named) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")

    def every(rows: list[tuple], *fields: str):
        kinds = F.array(*(F.struct(*(F.lit(v).alias(f) for f, v in zip(fields, r))) for r in rows))
        return kinds.cast("array<struct<" + ",".join(f"{f}:{'string' if f == 'capacity_name' else 'bigint'}" for f in fields) + ">>")

    parts = F.ceil(F.col("size") / F.col("k.capacity"))
    asked = sized.withColumn("k", F.explode(every(named, "capacity_name", "capacity")))
    counts = {r[0]: r[1:] for r in asked.groupBy("k.capacity_name").agg(F.sum("size"), F.sum(parts)).collect()}
    sharded = [(n, c, max(1, -(-counts[n][0] // shard_tokens), -(-counts[n][1] // shard_documents))) for n, c in named if n in counts]
    pieces = (
        sized.withColumn("_capacity", F.explode(every(sharded, "capacity_name", "capacity", "shards")))
        .select("doc_id", "size", "_capacity.*")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), (F.floor((F.col("size") - 1) / F.col("capacity"))).cast("int"))))
        .withColumn("first_token", F.col("piece") * F.col("capacity"))
        .withColumn("tokens", F.least(F.col("capacity"), F.col("size") - F.col("first_token")))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.col("shards")))
    )
    return pieces.groupBy("capacity_name", "shard").applyInPandas(_pack_shard, _PACKED)


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, the share of space that is used, and the least number of containers there can be."""
    used = packed.groupBy("capacity_name").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    bounds = capacities.groupBy("capacity_name").agg(F.min("capacity_tokens").alias("capacity"))
    return used.join(bounds, "capacity_name").select(
        "capacity_name", "containers", "tokens",
        (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("used_share"),
        F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"),
    )
