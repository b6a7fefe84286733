"""Piecewise position maps: ``pos delta`` pairs, source position = position - delta of the last pair at or before it.

Plain functions work on strings for use inside Arrow batches; the ``*_col`` functions are Spark expressions.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .let import let


def parse(text: str | None) -> list[tuple[int, int]]:
    numbers = [int(x) for x in (text or "").split()]
    return list(zip(numbers[::2], numbers[1::2]))


def delta_at(pairs: list[tuple[int, int]], pos: int) -> int:
    k = bisect_right(pairs, (pos, float("inf")))
    return pairs[k - 1][1] if k else 0


def to_source(text: str | None, pos: int) -> int:
    return pos - delta_at(parse(text), pos)


def to_source_local(text: str | None, entry_start: int, local: int) -> int:
    """Of a position counted from the start of one entry."""
    return to_source(text, entry_start + local) - to_source(text, entry_start)


def compose(outer: str | None, inner: str | None, length: int) -> str:
    """The map that applies outer, then inner, on positions 0..length.

    Its delta can change only at a pair of outer, or where outer's image crosses a pair of inner, so
    only those positions are looked at.
    """
    if not outer or not inner:
        return outer or inner or ""
    a, b = parse(outer), parse(inner)
    edges = {0}
    for k, (pos, delta) in enumerate([(0, 0), *a]):
        end = a[k][0] if k < len(a) else length + 1
        edges.add(pos)
        low, high = pos - delta, end - delta
        at = bisect_right(b, (low, float("-inf")))
        while at < len(b) and b[at][0] < high:
            edges.add(b[at][0] + delta)
            at += 1
    out, last = [], 0
    for pos in sorted(p for p in edges if 0 <= p <= length):
        middle = pos - delta_at(a, pos)
        delta = pos - (middle - delta_at(b, middle))
        if delta != last:
            out.append(f"{pos} {delta}")
            last = delta
    return " ".join(out)


def merge(first: str | None, second: str | None, first_length: int) -> str:
    """The map of two texts set one after the other."""
    out = parse(first)
    carried = last = out[-1][1] if out else 0
    for pos, delta in parse(second):
        if delta + carried != last:
            last = delta + carried
            out.append((pos + first_length, last))
    return " ".join(f"{p} {d}" for p, d in out)


@F.pandas_udf(T.StringType())
def compose_col(outer: pd.Series, inner: pd.Series, length: pd.Series) -> pd.Series:
    """:func:`compose` of columns."""
    return pd.Series([compose(a, b, int(n)) for a, b, n in zip(outer, inner, length)])


@F.pandas_udf(T.StringType())
def merge_col(first: pd.Series, second: pd.Series, first_length: pd.Series) -> pd.Series:
    """:func:`merge` of columns."""
    return pd.Series([merge(a, b, int(n)) for a, b, n in zip(first, second, first_length)])


def pairs_col(text: Column) -> Column:
    """ARRAY<STRUCT<pos, delta>> of a map; empty for NULL, '' and anything that is not pairs of numbers."""
    words = F.split(F.trim(text), "\\s+")
    numbers = F.transform(F.when(F.length(F.trim(text)) > 0, words), lambda x: x.try_cast("bigint"))
    none = F.array().cast("array<struct<pos:bigint,delta:bigint>>")

    def pairs(n: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / 2).cast("int") - 1), lambda k: F.struct(F.get(n, 2 * k).alias("pos"), F.get(n, 2 * k + 1).alias("delta")))
        return F.when(F.size(n) >= 2, F.filter(every, lambda p: p.pos.isNotNull() & p.delta.isNotNull())).otherwise(none)

    return let(numbers, pairs)


def to_source_col(text: Column, pos: Column) -> Column:
    before = F.filter(pairs_col(text), lambda p: p.pos <= pos)
    return F.when(F.coalesce(text, F.lit("")) == "", pos).otherwise(pos - F.coalesce(let(before, lambda b: F.get(b, F.size(b) - 1).delta), F.lit(0)))
