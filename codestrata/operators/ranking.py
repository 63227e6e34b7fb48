"""Running numbers over a whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import cut


def numbered(
    table: DataFrame, order: Sequence[str | Column], name: str, last: int | None = None
) -> DataFrame:
    """``table`` with 1, 2, … in ``order`` as ``name``; with ``last`` the rows up to that number.

    The rows are parted into ranges of the order and stored. The counts of the ranges, a row each,
    give every range its first number; within a range rows are ranked by themselves. No task sees
    more than a range, and ranges that begin behind ``last`` are not sorted at all.
    """
    ranges = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a second evaluation might draw the bounds elsewhere, so the parted rows are stored
    parted = cut(table.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = parted.groupBy("__range").agg(F.count("*").alias("__rows")).select(
        "__range", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    if last is not None:
        before = before.filter(F.col("__before") < last)
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    out = parted.join(before, "__range").withColumn(name, F.col("__before") + place)
    if last is not None:
        out = out.filter(F.col(name) <= last)
    return out.drop("__range", "__before")
