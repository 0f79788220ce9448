"""Global order without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def running(df: DataFrame, keys: list[str], sums: dict[str, str | Column]) -> DataFrame:
    """Adds `row` (from 0, by `keys`) and, for each name in `sums`, the total of that column over all rows
    before this one.

    `keys` must tell rows apart as far as their order matters; the rows are dealt into ranges of
    the keys, ranges are numbered on their own, and the totals of earlier ranges are added. Only
    those totals, one row for each range, are gathered and broadcast."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(*keys)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    offsets = totals.select(
        F.col("_range").alias("_of"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums],
    )
    numbered = ranged.select(
        "*",
        (F.row_number().over(inside) - 1).alias("_at"),
        *[(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - (F.col(c) if isinstance(c, str) else c)).alias(f"_s_{k}") for k, c in sums.items()],
    )
    joined = numbered.join(F.broadcast(offsets), numbered["_range"] == offsets["_of"])
    return joined.select(
        *df.columns,
        (F.col("_at") + F.col("_before")).cast("long").alias("row"),
        *[(F.col(f"_s_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums],
    )
