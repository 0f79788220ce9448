"""Binary files in a shared folder: written once by whichever task attempt ends first, read by Spark."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions


def _hadoop(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme: one without it lies in the session's default file system, not on a worker's disk."""
    path, store = _hadoop(spark, folder)
    return store.makeQualified(path).toString()


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    cut(spark.range(0))  # sets a checkpoint folder where none is named
    top = qualified(spark, spark.sparkContext.getCheckpointDir())
    return f"{top.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The worker's way to a folder. Spark's names of S3 are not pyarrow's; a path without scheme would be on its own disk."""
    scheme, mark, rest = folder.partition(":")
    if not mark:
        raise ValueError(f"{folder} has no scheme: see qualified()")
    return fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else f"file://{rest}" if scheme == "file" and not rest.startswith("//") else folder)


def put(folder: str, name: str, blocks: Iterator[bytes]) -> int:
    """Write a file under a name of this attempt and move it to its own: a lost or repeated attempt
    leaves no half file, and repeats put the same bytes. Returns the size."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    trial, size = f"{path}/_{name}.{uuid.uuid4().hex}", 0
    with store.open_output_stream(trial) as out:
        for block in blocks:
            out.write(block)
            size += len(block)
    store.move(trial, f"{path}/{name}")
    return size


def read(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path, content) of the folder's files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "content")


#: Bytes of a file that are read by one row, and at a time.
PART, CHUNK = 64 << 20, 1 << 20
#: The byte at which `_lines` are cut.
_SEPARATOR = b"\x1f"
#: ((path, start of the part), bytes), those of a part one after the other.
Chunks = Iterator[tuple[tuple[str, int], bytes]]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Chunks:
    for batch in batches:
        for path, start, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            store, own = _store(path)
            with store.open_input_file(own) as file:
                file.seek(start)
                while length > 0 and (data := file.read(min(CHUNK, length))):
                    yield (path, start), data
                    length -= len(data)


def _lines(batches: Iterator[pa.RecordBatch]) -> Chunks:
    now = None
    for batch in batches:
        paths, lines = batch.column("path").to_pylist(), batch.column("piece").to_pylist()
        bounds = [k for k in range(len(paths)) if not k or paths[k] != paths[k - 1]] + [len(paths)]
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            yield (paths[low], 0), (_SEPARATOR if paths[low] == now else b"") + _SEPARATOR.join(lines[low:high])
            now = paths[low]


def parts(spark: SparkSession, folder: str, suffix: str, part: int = PART) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Chunks]]:
    """Rows that stand for the folder's files, and what a task makes of them: the files' bytes as streams.

    Where workers can open files, a row is a range of `part` bytes, and rows of a large file go to several tasks.
    In a store that only Spark opens, its reader of lines streams each file whole, past its codec; a last byte
    that is the one at which lines are cut isn't seen there."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "length")
    try:
        _store(qualified(spark, folder))
    except (ValueError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        raw = spark.read.format("text").option("lineSep", _SEPARATOR.decode()).option("pathGlobFilter", f"*{suffix}")
        passing = spark._jvm.org.apache.hadoop.io.compress.PassthroughCodec
        raw = raw.option("io.compression.codecs", passing.CLASSNAME).option(passing.OPT_EXTENSION, suffix)
        return raw.load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece")), _lines
    starts = found.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(part).cast("long"))).alias("start"), "length")
    rows = starts.select("path", "start", F.least(F.lit(part).cast("long"), F.col("length") - F.col("start")).alias("length"))
    return rows.repartition(max(partitions(spark), spark.sparkContext.defaultParallelism), "path", "start"), _ranges


def create(spark: SparkSession, folder: str) -> str:
    """The folder, which then is there even if nothing is written to it."""
    path, store = _hadoop(spark, folder)
    store.mkdirs(path)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    path, store = _hadoop(spark, folder)
    store.delete(path, True)
