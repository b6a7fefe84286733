"""Refs (paths of child indexes), boundaries and half-open ranges, as Spark expressions.

Spark orders arrays of numbers element by element and a prefix before what it is a prefix of, which is the
document order of refs; ``<`` and ORDER BY work on them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(ref: Column, offset: Column | None = None) -> Column:
    """A boundary: a ref, with a text offset behind it if one is given and not NULL."""
    return ref if offset is None else F.when(offset.isNull(), ref).otherwise(F.array_append(ref, offset.cast("int")))


def range_of(start: Column, end: Column, start_offset: Column | None = None, end_offset: Column | None = None) -> Column:
    return F.struct(point(start, start_offset).alias("range_start"), point(end, end_offset).alias("range_end"))


def with_start(bounds: Column, start: Column) -> Column:
    """A range with another start."""
    return bounds.withField("range_start", start)


def with_end(bounds: Column, end: Column) -> Column:
    """A range with another end."""
    return bounds.withField("range_end", end)


def is_boundary(b: Column) -> Column:
    """Whether a value is a boundary: not empty, no negative and no NULL index."""
    return F.coalesce((F.size(b) > 0) & F.forall(b, lambda x: x.isNotNull() & (x >= 0)), F.lit(False))


def same_ref(a: Column, b: Column) -> Column:
    """Equal refs; NULL equals nothing, itself included."""
    return F.coalesce(a == b, F.lit(False))


def ref_key(ref: Column) -> Column:
    return F.coalesce(F.array_join(ref, ","), F.lit(""))


def starts_with(ref: Column, prefix: Column) -> Column:
    return F.coalesce((F.size(prefix) == 0) | (F.slice(ref, 1, F.greatest(F.size(prefix), F.lit(1))) == prefix), F.lit(False))


def ref_end(ref: Column) -> Column:
    """The boundary behind a node."""
    return F.concat(F.slice(ref, 1, F.greatest(F.size(ref) - 1, F.lit(0))), F.array(F.get(ref, F.size(ref) - 1) + 1))


def parent(ref: Column) -> Column:
    return F.slice(ref, 1, F.greatest(F.size(ref) - 1, F.lit(0)))


def block_span(start: Column, end: Column, block_count: Column) -> Column:
    """STRUCT<start_index, end_index> (end exclusive) of the top-level blocks a range touches.

    NULL if a boundary is none or lies behind the last block; empty if both boundaries are the same.
    """
    first, last = F.get(start, F.lit(0)), F.get(end, F.lit(0))
    valid = is_boundary(start) & is_boundary(end) & (first <= block_count) & (block_count >= 0)
    behind = F.when(last == block_count, block_count).when(F.size(end) == 1, last).otherwise(last + 1)
    empty = F.struct(first.alias("start_index"), first.alias("end_index"))
    return F.when(valid & (start == end), empty).when(
        valid & (last <= block_count), F.struct(first.alias("start_index"), F.greatest(first, behind).alias("end_index"))
    )
