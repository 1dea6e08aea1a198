"""Ordered computations over groups of any size.

A plain ``Window.partitionBy(group).orderBy(pos)`` sorts a whole group in one task. These helpers cut every group into
buckets along the order, work inside the buckets, and carry only one summary row per bucket across the group, so a
group that holds a third of all rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F




def _keyed(df: DataFrame, group: Sequence[str], bucket: Column) -> DataFrame:
    """``df`` with its group as one struct, never null itself, so that plain equality joins it, and its bucket.

    The windows, sums and joins over (group, bucket) share one shuffle of the rows.
    """
    return df.withColumn("__g", F.struct(*group)).withColumn("__b", bucket)


def _inside() -> WindowSpec:
    return Window.partitionBy("__g", "__b")


def _earlier() -> WindowSpec:
    return Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)


def spread_prefix_sum(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the inclusive sum of ``value`` over ``order`` within ``group``.

    ``bucket`` must not fall while ``order`` rises. Null groups form a group of their own; null values count as 0.
    An empty table gives an empty table.
    """
    cut = _keyed(df, group, bucket)
    totals = cut.groupBy("__g", "__b").agg(F.coalesce(F.sum(value), F.lit(0)).alias("__t"))
    offsets = totals.select("__g", "__b", F.coalesce(F.sum("__t").over(_earlier()), F.lit(0)).alias("__o"))
    inside = _inside().orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn("__p", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, ["__g", "__b"])
        .withColumn(out, F.col("__p") + F.col("__o"))
        .select(*df.columns, out)
    )


def spread_lag(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[str], values: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Adds ``prev_<value>`` for each of ``values``, and ``prev_exists``: those of the row just before within ``group``.

    ``bucket`` must not fall while ``order`` rises, and ``order`` should be unique within a group.
    """
    cut = _keyed(df, group, bucket)
    row = F.struct(*values)
    lasts = cut.groupBy("__g", "__b").agg(F.max_by(row, F.struct(*order)).alias("__l"))
    carried = lasts.select("__g", "__b", F.lag("__l").over(Window.partitionBy("__g").orderBy("__b")).alias("__c"))
    joined = cut.withColumn("__i", F.lag(row).over(_inside().orderBy(*order))).join(carried, ["__g", "__b"])
    before = F.coalesce("__i", "__c")
    return joined.withColumn("__v", before).select(*df.columns, F.col("__v").isNotNull().alias(f"{prefix}exists"), *[F.col("__v")[v].alias(f"{prefix}{v}") for v in values])


def spread_last(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the last non-null ``value`` at or before each row in ``order`` within ``group``.

    ``bucket`` must not fall while ``order`` rises; ties in ``order`` should be broken by it. An as-of join is a union
    of both sides followed by this.
    """
    cut = _keyed(df, group, bucket).withColumn("__v", value)
    lasts = cut.groupBy("__g", "__b").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("__l"))
    carried = lasts.select("__g", "__b", F.last("__l", True).over(_earlier()).alias("__c"))
    inside = _inside().orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("__i", F.last("__v", True).over(inside)).join(carried, ["__g", "__b"]).withColumn(out, F.coalesce("__i", "__c")).select(*df.columns, out)
