import os

import pytest

import corpus_pipeline
from tallyloom.llm import mixing, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    base = docs.limit(60).cache()
    odd = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "", "en", None, 0), (9003, " \n", "en", "src1", 2), (None, "no id here at all", "en", "src1", 5), (9005, "only once you see this", "en", "src2", 5), (9006, "only once you see this", "en", "src2", 5)], docs.schema)
    mixed = base.unionByName(odd).unionByName(odd.where("doc_id = 9005")).withColumn("key", mixing.F.lit("k"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, mixed, DATA)
        empty = stage(spark, mixed.limit(0), DATA)
        assert empty.count() == 0
        if name != "sharding":
            assert got.columns == mixed.columns and got.columns[: len(columns)] == columns
        ids = [r.doc_id for r in got.collect()]
        if name == "simhash near-dedup":
            assert ids.count(9005) == 1 and 9006 not in ids and {9001, 9002, 9003, None} <= set(ids) and len(set(ids)) == len(ids)
        elif name in ("toxicity", "benchmark decontamination"):
            assert ids.count(9005) == 2 and {9001, 9002, 9003, None} <= set(ids)
        elif name == "sharding":
            assert len(ids) == mixed.count()


def test_run(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    assert {r.shard for r in rows} <= set(range(8)) and 0 < len(rows)
    ids = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in rows} <= ids


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES][:13] == [f"op{k}" for k in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5
