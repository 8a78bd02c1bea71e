"""Running sums and ranks inside groups of any size, in two levels.

Rows are dealt by ranges of (group, order), so a large group lies over many partitions of about equal depth (Spark draws the
bounds from a sample; rows of equal keys stay together).  Totals per (group, range) are added up in order first, a few rows a
group; a window then runs inside one range only.  No task ever holds or sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papertrail.session import materialize

#: The column that numbers the ranges.
RANGE = "_range"


def ranged(df: DataFrame, group: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` with the number of its range, written once (the bounds are drawn once)."""
    n = ranges or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                      df.sparkSession.sparkContext.defaultParallelism)
    dealt = df.repartitionByRange(n, *group, *order).withColumn(RANGE, F.spark_partition_id())
    return materialize(dealt, "ranges")


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str,
                ranges: int | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the group before this one in ``order`` (unique in a
    group); 0 for the first."""
    rows = ranged(df, group, order, ranges)
    before = Window.unboundedPreceding, -1
    totals = (rows.groupBy(*group, RANGE).agg(F.sum(value).alias("_total"))
              .withColumn("_base", F.coalesce(F.sum("_total").over(
                  Window.partitionBy(*group).orderBy(RANGE).rowsBetween(*before)), F.lit(0))).drop("_total"))
    inside = F.sum(value).over(Window.partitionBy(*group, RANGE).orderBy(*order).rowsBetween(*before))
    return (rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(totals, [*group, RANGE])
            .withColumn(out, F.col("_base") + F.col("_inside")).drop("_base", "_inside", RANGE))


def rank(df: DataFrame, group: list[str], order: list[str], out: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``out``: the number of rows of the group before this one in ``order``."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), group, order, "_one", out, ranges).drop("_one")
