"""Where intermediate results may lie."""

from types import SimpleNamespace

import pytest

from tallyloom.functions import lineage


def session(master, named=None, have=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: context.folder, setCheckpointDir=lambda f: setattr(context, "folder", f))
    context.folder = have
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named))


def test_folders():
    assert lineage.checkpoint_folder(session("local[2]", have="/x")) == "/x"
    assert lineage.checkpoint_folder(session("spark://a:1", named="hdfs://b/c")) == "hdfs://b/c"
    assert "checkpoints" in lineage.checkpoint_folder(session("local[2]"))
    for master in ("spark://a:1", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError, match="checkpoint.dir"):
            lineage.checkpoint_folder(session(master))


def test_folders_go(spark, tmp_path):
    seen = []

    def write(folder):
        seen.append(folder.removeprefix("file:"))
        spark.range(3).write.parquet(folder)

    assert lineage.through_files(spark, write, spark.read.parquet).count() == 3
    with pytest.raises(ZeroDivisionError):
        lineage.through_files(spark, write, lambda folder: 1 / 0)
    from pathlib import Path

    assert len(seen) == 2 and not any(Path(f).exists() for f in seen)
