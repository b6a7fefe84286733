"""Naming a value inside a Spark expression, so that it is written and computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value bound as the element of a one-element array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
