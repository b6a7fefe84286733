"""The engine's scalar functions under names for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Each is a SQL function, so Catalyst sees through it.
_FUNCTIONS = {
    "tree_ref_key(ref ARRAY<INT>) RETURNS STRING": "coalesce(array_join(ref, ','), '')",
    "tree_ref_parent(ref ARRAY<INT>) RETURNS ARRAY<INT>": "slice(ref, 1, greatest(size(ref) - 1, 0))",
    "tree_ref_end(ref ARRAY<INT>) RETURNS ARRAY<INT>": "concat(slice(ref, 1, greatest(size(ref) - 1, 0)), array(element_at(ref, -1) + 1))",
    "tree_ref_starts_with(ref ARRAY<INT>, prefix ARRAY<INT>) RETURNS BOOLEAN": "coalesce(size(prefix) = 0 OR slice(ref, 1, greatest(size(prefix), 1)) = prefix, false)",
    "tree_is_boundary(ref ARRAY<INT>) RETURNS BOOLEAN": "coalesce(size(ref) > 0 AND forall(ref, x -> x IS NOT NULL AND x >= 0), false)",
    "tree_units(t STRING) RETURNS INT": "CAST(octet_length(encode(t, 'UTF-16BE')) / 2 AS INT)",
    "tree_delta_source(delta STRING, pos BIGINT) RETURNS BIGINT": (
        "pos - coalesce(try_element_at(transform(filter(sequence(0, greatest(CAST(size(split(delta, ' ')) / 2 AS INT) - 1, 0)), "
        "k -> try_cast(get(split(delta, ' '), 2 * k) AS BIGINT) <= pos), k -> try_cast(get(split(delta, ' '), 2 * k + 1) AS BIGINT)), -1), 0)"
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Registers the functions for the session and returns their names."""
    names = []
    for head, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.partition("(")[0])
    return names
