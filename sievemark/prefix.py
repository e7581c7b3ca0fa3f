"""Sums over the earlier rows of a group, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds to each row the sum of ``value`` over the earlier rows of its group.

    Rows are range-partitioned by group and order and summed within each partition; only one number per partition and group in it
    crosses partitions, so a group that holds most rows is spread over many.
    """
    dealt = df.repartitionByRange(F.col(group).asc_nulls_first(), *order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "dealt")  # partition numbers stay what they were
    sums = dealt.groupBy("_part", group).agg(F.sum(value).alias("_sum"))
    # At most one row per partition and group in it.
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("_part").alias("_p"), F.col(group).alias("_g"), "_before")
    inside = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(before, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn(out, F.col("_before") + F.col("_inside")).drop("_part", "_p", "_g", "_before", "_inside")
