"""What several corpus operators share: cutting lineage, global order, joins with hot keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.order import running

__all__ = ["cut", "join_hot", "partitions", "running", "small_batches", "table"]

#: A key with more than this share of a join's rows is hot, so there are at most 1 / share of them.
HOT_SHARE = 1 / 1000


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is planned inside sends Python at most so many rows at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join to `right`, which has one row for each key and in `weight` how many rows of
    `left` have it. Keys with more than HOT_SHARE of all rows, at most 1 / HOT_SHARE of them, are
    joined by broadcast where their rows lie; the others by a shuffle. Both inputs are read
    twice, so they should be cut."""
    total = right.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) > max(total * HOT_SHARE, 100)
    hot, cold = right.where(is_hot).drop(weight), right.where(~is_hot).drop(weight)
    near = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return near.unionByName(rest)
