"""Problem 7: mixing sources to target weights by a low-discrepancy schedule.

The mixture is a sequence of slots of equal token size.  Slot k gets the source into whose part of the
cumulated weights the k-th golden-ratio point falls, so that every stretch of the mixture has the target
shares as nearly as whole slots allow.  A source that its repeat cap keeps below its share gives all it
may, and the others fill up what it lacks in proportion to their shares.  Each source is shuffled (anew for every repetition) and cut in
blocks of the slot's size; its r-th block goes to its r-th slot.

Running sums over a source and over the slots are made in two levels, within hash buckets and then over
the buckets' totals, so no source is ever put in order by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import cut
from .tokens import RANKS, token_count

GOLDEN = 0.6180339887498949
#: Tokens of a slot.
SLOT_TOKENS = 2_048
#: Documents in a bucket of the shuffle, on average, and slots in a bucket of the schedule.
BUCKET = 50_000
#: Documents per source that are picked to fit what is lacking at the end of its quota.
FILL_ROUNDS = 3
#: Sources that may have a target.
MOST_SOURCES = 10_000


def source_name(source: Column) -> Column:
    """A source in lower case without outer blanks."""
    return F.lower(F.trim(source))


def running(df: DataFrame, group: str, bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the group before each row, by bucket and then by ``order``."""
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    before = totals.select(group, bucket, F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_before"))
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(before, [group, bucket]).withColumn(name, F.col("_local") + F.col("_before")).drop("_local", "_before")


def targets_of(targets: DataFrame) -> DataFrame:
    """(source, share, max_repeats): positive shares, scaled to sum 1; targets of equal names add up."""
    named = (
        targets.where("target_share > 0 AND source IS NOT NULL")
        .groupBy(source_name(F.col("source")).alias("source"))
        .agg(F.sum("target_share").alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("max_repeats"))
    )
    return named.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy()))


def fill_up(caps: list[int], shares: list[float], total: float) -> list[int]:
    """What each source gives of ``total`` tokens: its share, but at most its cap; what is lacking then is shared out among the rest, again by share."""
    quotas = [0] * len(caps)
    left, weight = min(total, sum(caps)), sum(shares)
    # in the order in which sources reach their caps as the total grows
    for i in sorted(range(len(caps)), key=lambda i: caps[i] / shares[i]):
        quotas[i] = min(caps[i], int(left * shares[i] / weight))
        left -= quotas[i]
        weight -= shares[i]
    return quotas


def plan_mixture(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[dict]:
    """Per source with a target: share, repeats, tokens there are, the tokens it gives, and the end of its part of the cumulated quotas.

    ``total_tokens`` is the mixture's size, by default that of all documents of sources with a target, and
    never above what the repeat caps allow.  A source without documents gives nothing.
    Only one row per target reaches the driver (targets are a control table; more than MOST_SOURCES are an error).
    """
    have = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    rows = targets_of(targets).join(have, "source", "left").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} targets")
    rows = sorted((r.asDict() for r in rows if r["tokens"]), key=lambda r: r["source"])
    total = sum(r["tokens"] for r in rows) if total_tokens is None else total_tokens
    quotas = fill_up([r["tokens"] * r["max_repeats"] for r in rows], [r["share"] for r in rows], total)
    whole, high = max(sum(quotas), 1), 0
    for r, quota in zip(rows, quotas):
        r["quota"] = quota
        high += quota
        r["high"] = high / whole
    return [r for r in rows if r["quota"]]


def mixture(
    documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    total_tokens: int | None = None, slot_tokens: int = SLOT_TOKENS, seed: int = 17, ranks_path: str = RANKS, bucket: int = BUCKET,
) -> DataFrame:
    """(slot, position, source, doc_id, use, tokens): the mixture in order; ``use`` counts a document's uses from 0.

    Documents stay whole: each goes to the slot in which its first token falls, so a slot's size differs
    from ``slot_tokens`` by less than a document.  A source gives documents until its quota is reached, the
    last one only if that brings it nearer.  Documents without tokens, without a target or with a NULL key
    are not used; of unlike rows of a key the one with the least source counts, and of these one, the same
    whatever the order of rows.  Tokens are counted where the texts are, so no text is shuffled.
    """
    one = documents.where(F.col(key).isNotNull() & (F.col(text) != "") & F.col(source).isNotNull())
    one = one.select(F.col(key).alias("doc_id"), source_name(F.col(source)).alias("source"), F.xxhash64(text).alias("digest"), token_count(F.col(text), ranks_path).alias("tokens"))
    sized = cut(one.groupBy("doc_id").agg(F.min(F.struct("source", "digest", "tokens")).alias("row")).select("doc_id", "row.source", "row.tokens").where("tokens > 0"))
    plan = plan_mixture(sized, targets, total_tokens)
    spark = documents.sparkSession
    schema = "source string, quota bigint, have bigint, uses int, documents bigint"
    sources = spark.createDataFrame(
        [(r["source"], r["quota"], r["tokens"], -(-r["quota"] // r["tokens"]), r["documents"]) for r in plan], schema
    )

    # every use of every document, shuffled per use, at its place in the source's stream
    uses = (
        sized.join(sources, "source")
        .withColumn("use", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
        .withColumn("shuffled", F.xxhash64("doc_id", "use", F.lit(seed)))
        .withColumn("bucket", F.col("use") * F.lit(1 << 20) + F.pmod(F.col("shuffled"), F.greatest(F.floor(F.col("documents") / F.lit(bucket)), F.lit(1))))
    )
    placed = cut(running(uses, "source", "bucket", ["shuffled", "doc_id"], F.col("tokens"), "start").select("source", "quota", "doc_id", "use", "tokens", "start"))
    taken = placed.where(F.col("start") + F.col("tokens") <= F.col("quota"))
    for _ in range(FILL_ROUNDS):
        # what a source still lacks is filled by the unused document that comes nearest to it
        used = taken.groupBy("source").agg(F.sum("tokens").alias("used"))
        lack = sources.join(used, "source", "left").select("source", F.coalesce("used", F.lit(0)).alias("used"), (F.col("quota") - F.coalesce("used", F.lit(0))).alias("lack"))
        free = placed.join(taken.select("doc_id", "use"), ["doc_id", "use"], "left_anti").join(lack, "source").where(F.col("tokens") < 2 * F.col("lack"))
        near = F.struct(F.abs(F.col("tokens") - F.col("lack")).alias("off"), "doc_id", "use")
        filler = free.groupBy("source").agg(F.min_by(F.struct("source", "quota", "doc_id", "use", "tokens", F.col("used").alias("start")), near).alias("d")).select("d.*")
        taken = cut(taken.unionByName(filler))
    placed = taken.withColumn("rank", F.floor(F.col("start") / F.lit(slot_tokens)))

    # the schedule: slots of the golden ratio, ranked within their source
    slots_needed = sum(-(-r["quota"] // slot_tokens) for r in plan)
    most = slots_needed + 8 * len(plan) + 64
    slots = spark.range(most).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0)).alias("point"))
    border = F.array(*(F.lit(r["high"]) for r in plan[:-1])).cast("array<double>")
    names = F.array(*(F.lit(r["source"]) for r in plan)).cast("array<string>")
    slots = slots.withColumn("source", F.get(names, F.size(F.filter(border, lambda high: high <= F.col("point")))))
    slots = slots.withColumn("bucket", F.floor(F.col("slot") / F.lit(bucket)))
    ranked = running(slots.select("slot", "source", "bucket"), "source", "bucket", ["slot"], F.lit(1), "rank").drop("bucket")

    # blocks beyond the last slot of their source (fewer than one in a thousand) follow the schedule's end
    chosen = placed.select("source", "doc_id", "use", "tokens", "rank", "start").join(ranked, ["source", "rank"], "left")
    chosen = chosen.withColumn("slot", F.coalesce("slot", F.lit(most) + F.col("rank")))
    order = Window.partitionBy("slot", "source").orderBy("start")
    return chosen.withColumn("position", (F.row_number().over(order) - 1)).select("slot", "position", "source", "doc_id", F.col("use").cast("int").alias("use"), "tokens")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: documents, uses, tokens, the share reached and the share aimed at."""
    per = mixed.groupBy("source").agg(
        F.countDistinct("doc_id").alias("documents"), F.count("*").alias("uses"), (F.max("use") + 1).alias("most_uses"), F.sum("tokens").alias("tokens")
    )
    per = per.withColumn("_all", F.sum("tokens").over(Window.partitionBy()))  # one row per target
    return (
        targets_of(targets).join(per, "source", "left")
        .select("source", F.col("share").alias("target_share"), F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("actual_share"),
                "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("most_uses", "documents", "uses", "tokens")))
    )
