"""Running sums and positions over a whole table, without a window in one task.

Rows are dealt by range and summed within each range; the ranges' sums, one row by range, meet in a window of their own. The
dealt rows are checkpointed, since both uses must see the same ranges, also after an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage_cut import cut


def running_sum(df: DataFrame, order: list[Column], amount: Column, out: str) -> DataFrame:
    """df with out: the sum of amount from the first row in this order up to the row itself. The order should be a total one."""
    part, own = "__tl_part", "__tl_amount"
    dealt = cut(df.withColumn(own, amount.cast("bigint")).repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sums = dealt.groupBy(part).agg(F.sum(own).alias("__tl_sum"))
    base = sums.select(part, (F.sum("__tl_sum").over(Window.orderBy(part)) - F.col("__tl_sum")).alias("__tl_base"))
    within = F.sum(own).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # one row by range
    return dealt.withColumn(out, within).join(F.broadcast(base), part).withColumn(out, F.col(out) + F.col("__tl_base")).drop(part, own, "__tl_base")


def position(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with out: the row's place in this order, from 0."""
    return running_sum(df, order, F.lit(1), out).withColumn(out, F.col(out) - 1)
