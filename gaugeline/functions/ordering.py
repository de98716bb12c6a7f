"""Order-dependent helpers that stay balanced when one group holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.session import cut_lineage


def numbered(frame: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Exact 1-based row number per group, without sorting a whole group in one task.

    Rows are range-partitioned on (group, order), so a big group spreads over many slices. The sliced
    rows are checkpointed because the slice borders come from a sample and must not change between the
    count and the numbering. The order columns must be unique within a group.
    """
    sliced = cut_lineage(
        frame.repartitionByRange(*group, *order).withColumn("_slice", F.spark_partition_id())
    )
    counts = sliced.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_rank", F.row_number().over(within))
        .join(offsets, [*group, "_slice"])
        .withColumn(name, (F.col("_rank") + F.col("_before")).cast("long"))
        .drop("_slice", "_rank", "_before")
    )


def last_seen(
    frame: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, width: int = 100_000
) -> DataFrame:
    """Carry the last non-null ``value`` forward per key (current row included), as an as-of join does.

    ``order[0]`` must be an integer sequence: the timeline of a key is cut into stretches of ``width``,
    each stretch is filled on its own and starts from the last value of the earlier stretches.
    """
    stretched = frame.withColumn("_value", value).withColumn("_stretch", F.floor(F.col(order[0]) / F.lit(width)))
    position = F.when(F.col("_value").isNotNull(), F.struct(*order))
    ends = stretched.groupBy(*keys, "_stretch").agg(F.max_by("_value", position).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*keys, "_stretch", F.last("_end", ignorenulls=True).over(earlier).alias("_start"))
    so_far = (
        Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        stretched.withColumn("_here", F.last("_value", ignorenulls=True).over(so_far))
        .join(starts, [*keys, "_stretch"])
        .withColumn(name, F.coalesce("_here", "_start"))
        .drop("_value", "_stretch", "_here", "_start")
    )
