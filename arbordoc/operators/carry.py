"""The last value so far along a group's order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Places in a bucket.
BUCKET = 4_096


def carry_forward(df: DataFrame, group: str, place: str, value: Column, name: str, bucket: int = BUCKET) -> DataFrame:
    """``df`` with the last value that is not NULL at or before each row's place.

    ``place`` is an integer column that orders a group; ``value`` must be orderable and not depend on other
    rows of the same place.  Rows are put in order within buckets of places; between buckets, one row of
    each is carried.  A group that holds a third of all rows is so no task's burden.
    """
    bucketed = df.withColumn("_bucket", F.floor(F.col(place) / bucket)).withColumn("_value", value)
    inside = Window.partitionBy(group, "_bucket").orderBy(place).rangeBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("_value").isNotNull(), F.struct(F.col(place).alias("at"), F.col("_value").alias("v"))))
    carried = bucketed.groupBy(group, "_bucket").agg(last.alias("_last")).select(group, "_bucket", F.last("_last", ignorenulls=True).over(across).alias("_carried"))
    local = bucketed.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    return local.join(carried, [group, "_bucket"]).withColumn(name, F.coalesce("_local", "_carried.v")).drop("_bucket", "_value", "_local", "_carried")
