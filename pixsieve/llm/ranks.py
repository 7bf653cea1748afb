"""Exact ranks of rows in groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixsieve.llm.common import stored


def ranked(rows: DataFrame, group: str, order: tuple[str, ...]) -> DataFrame:
    """The rows, stored, with rank (place in the group from 0, in ascending order, nulls first) and n (rows of the group).

    One range partition sorts all groups; a part's offset in a group is a running sum over parts, so no task holds more than a
    part. Rows equal in all of group and order may stand in either order; rand splits them where they are many.
    """
    keys = [F.col(group), *(F.col(c).asc_nulls_first() for c in order)]
    # a place within the task: the low 33 bits of the id that Spark gives each row of a partition
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    in_order = rows.repartitionByRange(*keys, F.rand(7)).sortWithinPartitions(*keys)
    placed = stored(in_order.select("*", F.spark_partition_id().alias("part"), place.alias("place")), "ranked")
    parts = placed.groupBy(group, "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("held"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        group, "part", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("held").over(whole).alias("n")
    )
    return placed.join(offsets, [group, "part"]).withColumn("rank", F.col("place") + F.col("shift")).drop("part", "place", "shift")
