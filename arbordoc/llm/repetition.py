"""Problem 8: the share of a text that repeats earlier content of the same text, and risk-controlled cutoffs on it.

Repeated content is measured on letters and digits, case, spacing and punctuation aside.  A letter or
digit is repeated if it stands in

* five words in a row that occurred earlier in the text,
* twelve characters in a row that occurred earlier, where the text runs on without blanks (scripts
  written without word spaces),
* a sentence, or a paragraph (line), that occurred earlier as a whole, however short.

Measuring that is the costly part.  A far cheaper score, in the JVM, decides which documents are rejected
at all: the share of a text's pairs of words (character triples in scripts without blanks), or of its
sentences, that stood in it before.
Its cutoffs come from labelled holdouts: of all cutoffs on a grid, the least whose false-rejection rate
(good documents at or above the cutoff) is below a limit by an exact binomial bound, at a confidence
corrected for all cutoffs and strata that were tried.  An exact check of the rejected documents follows.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.let import let

PHRASE_WORDS = 5
PHRASE_CHARS = 12
_WORD = re.compile(r"[^\W_]+")
_SENTENCE_END = re.compile(r"[.!?…]+(?!\w)|[。！？｡]+|\n+")
# First and last code points of scripts written without blanks between words.
_UNSPACED_RANGES = "฀-໿က-႟ក-៿々-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
_UNSPACED = re.compile(f"[{_UNSPACED_RANGES}]")


def repeated_units(text: str) -> tuple[int, int]:
    """(repeated letters and digits, all letters and digits) of a text."""
    spans = [m.span() for m in _WORD.finditer(text)]
    if not spans:
        return 0, 0
    words = [text[a:b].casefold() for a, b in spans]
    marked = [False] * len(words)

    # phrases of words
    seen: set = set()
    if len(words) > PHRASE_WORDS:
        ids: dict[str, int] = {}
        coded = [ids.setdefault(w, len(ids)) for w in words]
        for i, gram in enumerate(zip(*(coded[k:] for k in range(PHRASE_WORDS)))):
            if gram in seen:
                marked[i : i + PHRASE_WORDS] = [True] * PHRASE_WORDS
            else:
                seen.add(gram)

    # sentences, then paragraphs, that stood there before as a whole
    ends = [(m.start(), m.group()[0] == "\n") for m in _SENTENCE_END.finditer(text)]
    for breaks in ([a for a, _ in ends], [a for a, line in ends if line]):
        whole: set[str] = set()
        first = 0
        for stop in [*breaks, len(text)]:
            last = first
            while last < len(words) and spans[last][0] < stop:
                last += 1
            if last > first:
                key = "".join(words[first:last])
                if key in whole:
                    marked[first:last] = [True] * (last - first)
                whole.add(key)
            first = last

    # phrases of characters, in stretches of words without blanks between them
    total = sum(b - a for a, b in spans)
    repeated = 0
    grams: set[str] = set()
    k = 0
    while k < len(words):
        if not _UNSPACED.search(words[k]):
            if marked[k]:
                repeated += spans[k][1] - spans[k][0]
            k += 1
            continue
        start = k
        while k < len(words) and _UNSPACED.search(words[k]):
            k += 1
        chars = "".join(text[a:b] for a, b in spans[start:k])
        cover = bytearray(len(chars))
        low = chars.lower()
        if len(low) != len(chars):
            low = chars
        for i in range(len(low) - PHRASE_CHARS + 1):
            gram = low[i : i + PHRASE_CHARS]
            if gram in grams:
                cover[i : i + PHRASE_CHARS] = b"\x01" * PHRASE_CHARS
            else:
                grams.add(gram)
        at = 0
        for j in range(start, k):
            n = spans[j][1] - spans[j][0]
            repeated += n if marked[j] else sum(cover[at : at + n])
            at += n
    return repeated, total


_COUNTS = T.StructType().add("repeated", T.LongType()).add("total", T.LongType())


@F.pandas_udf(_COUNTS)
def _repeated_udf(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(0, 0) if t is None else repeated_units(t) for t in text], columns=["repeated", "total"])


def repetition(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with ``repeated``, ``total`` (letters and digits) and ``repeated_share``.

    NULL, empty and letterless texts have a share of 0.  No shuffle; whole texts are measured.
    """
    counts = _repeated_udf(F.col(text))
    out = documents.withColumn("_counts", counts).select(*documents.columns, "_counts.*")
    return out.withColumn("repeated_share", F.when(F.col("total") > 0, F.col("repeated") / F.col("total")).otherwise(F.lit(0.0)))


def language_stratum(lang: Column) -> Column:
    """The primary language subtag in lower case; 'und' for anything that is none."""
    tag = F.lower(F.regexp_extract(F.coalesce(lang, F.lit("")), "^\\s*([A-Za-z]{2,3})(?:[-_].*)?\\s*$", 1))
    return F.when(tag != "", tag).otherwise("und")


def binomial_upper_bound(bad: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a rate seen ``bad`` times in ``n`` trials, at confidence 1 - delta."""
    if n <= 0 or bad >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(bad + 1)]

    def tail(p: float) -> float:
        a, b = math.log(p), math.log1p(-p)
        return sum(math.exp(c + k * a + (n - k) * b) for k, c in enumerate(logs))

    low, high = bad / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if tail(mid) > delta:
            low = mid
        else:
            high = mid
    return high


def seen_before(text: Column) -> Column:
    """How much of a text stood in it before, by pairs of words (character triples in scripts without blanks) or by whole sentences, whichever is more.

    A repeated phrase has no new pair but at its edges, and a repeated sentence or line is no new sentence, so
    a text that repeats much scores high; pairs of words seldom recur by chance.  Computed in the JVM; 0
    for NULL, empty and letterless texts.
    """
    low, dense = F.lower(text), f"[{_UNSPACED_RANGES}]"
    words = lambda t: F.split(t, "[^\\p{L}\\p{N}]+")

    def share(units: Column) -> Column:
        return F.when(F.size(units) > 0, 1 - F.size(F.array_distinct(units)) / F.size(units))

    def pairs(w: Column) -> Column:
        return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    triples = F.regexp_extract_all(low, F.lit(f"(?=({dense}{{3}}))"), F.lit(1))
    mixed = let(words(F.regexp_replace(low, dense, " ")), lambda w: F.concat(F.transform(triples, lambda t: F.xxhash64(t)), pairs(w)))
    some = (F.octet_length(text) > F.length(text)) & low.rlike(dense)
    phrases = F.when(some, let(mixed, share)).otherwise(let(let(words(low), pairs), share))
    sentences = F.split(low, "[.!?…。！？｡\\n]+\\s*")
    return F.coalesce(F.greatest(phrases, let(sentences, share)), F.lit(0.0)).alias("seen_before")


def size_stratum(text: Column) -> Column:
    """The power of four below a text's length: longer texts have fewer new words."""
    return F.floor(F.log2(F.greatest(F.length(text), F.lit(1))) / 2).cast("int")


#: Cutoffs on the score that are tried.
GRID = tuple(k / 20 for k in range(1, 20))
#: The share of a stratum's good documents that may be rejected, and so have to be checked.
LIMIT = 0.3


def risk_controlled_cutoffs(
    holdout: DataFrame, stratum: str, score: str, good: str, grid: tuple = GRID, limit: float = LIMIT, delta: float = 0.05
) -> dict[str, float]:
    """For each stratum, the least cutoff of the grid whose false-rejection rate is certified to be at most ``limit``.

    ``good`` is the boolean label of the holdout rows.  Every bound holds at confidence 1 - delta /
    (strata x cutoffs), so that all of them hold together at 1 - delta (Bonferroni).  Strata without a
    certified cutoff are left out; so are, before they are counted as tried, those with so few labels that
    no cutoff could be certified.  Only counts by stratum and cutoff reach the driver, for at most the
    holdout's rows over that number of strata.
    """
    cutoffs = sorted(grid)
    place = F.lit(0)
    for c in cutoffs:
        place = place + (F.col(score) >= F.lit(c)).cast("int")
    per = holdout.where(F.col(good)).groupBy(F.col(stratum).alias("s"), place.alias("k")).count()
    enough = math.ceil(math.log(delta / len(cutoffs)) / math.log1p(-limit))
    told = per.groupBy("s").agg(F.sum("count").alias("n"), F.collect_list(F.struct("k", "count")).alias("places")).where(F.col("n") >= enough).collect()
    out = {}
    for r in told:
        for k, c in enumerate(cutoffs, 1):
            rejected = sum(p["count"] for p in r["places"] if p["k"] >= k)
            if binomial_upper_bound(rejected, r["n"], delta / (len(told) * len(cutoffs))) <= limit:
                out[r["s"]] = c
                break
    return out


def repetitive_documents(
    documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", share: float = 1 / 3,
    holdout_rows: int = 20_000, limit: float = LIMIT, delta: float = 0.05, labels: DataFrame | None = None,
) -> DataFrame:
    """(key, stratum, cutoff, repeated, total): the documents rejected for repetition, one row each.

    Strata are a text's language and its size.  The holdout, ``holdout_rows`` rows expected, chosen by a
    hash of the key, is labelled by measuring it (good: less than ``share`` is repeated), or by ``labels``
    (key, good) if given; it gives each stratum the least cutoff on :func:`seen_before` that is certified
    to reject at most ``limit`` of the good documents.  Documents at or above their stratum's cutoff are
    rejected; in strata without a certified cutoff all are.  Of these, and of no others, the repeated share
    is measured, and those below ``share`` are let go.  A lower limit means higher cutoffs, less to
    measure, and repetitive documents of varied words lost.

    Rows with a NULL key are left out; of rows with one key each is looked at, and one that is rejected counts.
    """
    whole = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    stratum = F.concat_ws("/", language_stratum(F.col("_lang")), size_stratum(F.col("_text")))
    scored = whole.where("_text IS NOT NULL AND _text <> ''").select("_key", "_text", stratum.alias("stratum"), seen_before(F.col("_text")).alias("score"))
    if labels is None:
        part = min(1.0, holdout_rows / max(documents.count(), 1))
        chosen = F.pmod(F.xxhash64("_key"), F.lit(1_000_003)) < F.lit(int(part * 1_000_003))
        counts = _repeated_udf(F.col("_text"))
        holdout = scored.where(chosen).withColumn("_counts", counts).withColumn("good", F.col("_counts.repeated") < F.lit(share) * F.col("_counts.total"))
    else:
        holdout = scored.join(labels.select(F.col(key).alias("_key"), "good"), "_key")
    cutoffs = risk_controlled_cutoffs(holdout, "stratum", "score", "good", limit=limit, delta=delta)
    cutoff = F.lit(0.0)
    if cutoffs:
        known = F.create_map(*(F.lit(x) for pair in sorted(cutoffs.items()) for x in pair))
        cutoff = F.coalesce(F.element_at(known, F.col("stratum")), cutoff)
    rejected = scored.withColumn("cutoff", cutoff).where(F.col("score") >= F.col("cutoff"))
    checked = rejected.select(F.col("_key").alias(key), "stratum", "cutoff", _repeated_udf(F.col("_text")).alias("_counts")).select(key, "stratum", "cutoff", "_counts.*")
    return checked.where((F.col("total") > 0) & (F.col("repeated") >= F.lit(share) * F.col("total") - F.lit(1e-9))).dropDuplicates([key])
