"""Intermediate results that outlive the executors that made them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: the one that is set, else the one that spark.checkpoint.dir names. Only
    a session without other machines may do without; it gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        alone = context.master.startswith("local") and not context.master.startswith("local-cluster")
        if named is None and not alone:
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, stored in the shared checkpoint folder, with no lineage behind them. A session
    made by `session` deletes the files when nothing refers to the rows any more."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows that one task of a join or of a count holds at once.
PER_TASK = 1 << 19


def tasks_for(rows: int) -> int:
    """Tasks that `rows` rows need."""
    return max(1, -(-rows // PER_TASK))


@contextmanager
def shuffled_into(spark: SparkSession, tasks: int) -> Iterator[None]:
    """What is planned and run inside shuffles into so many partitions; adaptive execution doesn't merge them,
    since it judges them by their compressed size."""
    wanted = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def folder_of_its_own(spark: SparkSession, kind: str) -> Iterator[str]:
    """The path of a new folder that all executors share; it goes at the end, whatever happens."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def through_files(spark: SparkSession, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What `read` returns of what `write` wrote to a new folder that all executors share. The rows are
    stored and the folder goes, whatever happens."""
    with folder_of_its_own(spark, "files") as folder:
        write(folder)
        return cut(read(folder))
