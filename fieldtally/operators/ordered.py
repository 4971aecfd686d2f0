"""Ordered logic that stays parallel when one key holds a large share of the rows.

A plain window puts a whole key into one task. Here the order axis is cut into buckets; each
(key, bucket) is its own window partition and only one summary row per bucket crosses over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_by_bucket(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: list[str], prefix: str = "prev_"
) -> DataFrame:
    """Previous row's ``values`` within ``keys`` ordered by ``order``, as ``prev_*`` columns.

    ``bucket`` must not decrease along ``order``. Keys may be null.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_self", F.struct(*[F.col(v) for v in values]))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    rows = rows.withColumn("_lag", F.lag("_self").over(inside))

    tails = rows.groupBy(*keys, "_bucket").agg(
        F.max_by("_self", F.struct(*[F.col(o) for o in order])).alias("_tail")
    )
    across = Window.partitionBy(*keys).orderBy("_bucket")
    carried = tails.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_k_bucket"),
        F.lag("_tail").over(across).alias("_carry"),
    ).filter(F.col("_carry").isNotNull())

    match = F.col("_bucket") == F.col("_k_bucket")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = rows.join(carried, match, "left")
    previous = F.coalesce(F.col("_lag"), F.col("_carry"))
    return joined.select(*df.columns, *[previous[v].alias(f"{prefix}{v}") for v in values])


def running_sum_by_bucket(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, out: str
) -> DataFrame:
    """Running sum of ``value`` within ``keys``: a sum inside the bucket plus the earlier buckets' total."""
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_inner", F.sum(value).over(inside))
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.sum(value).alias("_total"))
        .select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            F.col("_bucket").alias("_k_bucket"),
            F.sum("_total").over(across).alias("_before"),
        )
        .filter(F.col("_before").isNotNull())
    )
    match = F.col("_bucket") == F.col("_k_bucket")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(before, match, "left").select(
        *df.columns, (F.col("_inner") + F.coalesce(F.col("_before"), F.lit(0))).alias(out)
    )


def carry_forward_by_bucket(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, out: str
) -> DataFrame:
    """Last non-null ``value`` up to and including each row, within ``keys``."""
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_inner", F.last(value, ignorenulls=True).over(inside))
    position = F.struct(*[F.col(o) for o in order])
    tails = rows.groupBy(*keys, "_bucket").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), position)).alias("_tail")
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_k_bucket"),
        F.last("_tail", ignorenulls=True).over(before).alias("_carry"),
    ).filter(F.col("_carry").isNotNull())
    match = F.col("_bucket") == F.col("_k_bucket")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(carried, match, "left").select(*df.columns, F.coalesce("_inner", "_carry").alias(out))
