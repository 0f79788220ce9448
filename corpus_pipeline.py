"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's rows as
Parquet in the cluster's shared folder and reads them back as the next one's documents. All but the
last return the columns of `docs`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontam, files, mixing, sharding, simhash, toxicity
from tallyloom.llm.common import cut, table


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that `docs` doesn't have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _row_key() -> Column:
    """Rows with one id and one text are the same document, whatever their other columns hold."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the ordinal model, fitted on the labelled documents, doesn't reject. Null and empty
    texts stay; an empty table stays empty; without labels nothing is rejected."""
    model = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    flag = _fresh(docs, "toxic")
    return toxicity.grade_toxicity(docs, model, keep=flag).where(~F.col(flag)).drop(flag)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (Jaccard similarity of five-word shingles at
    least 0.8), the one with the least id, once. Null ids come after all others. Documents without
    words have nothing to compare and stay."""
    key, worded = _fresh(docs, "key"), F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    groups = simhash.near_groups(docs.where(worded).select(_row_key().alias("key"), "text"), id_col="key")
    # groups are named by keys here; the least document id among a group's keys says which one stays
    number = F.when(~F.startswith("key", F.lit("null:")), F.substring_index("key", ":", 1).cast("long"))
    best = groups.groupBy("component_id").agg(F.min(F.struct(number.isNull().alias("none"), number.alias("id"), "key")).alias("best"))
    rows = groups.groupBy("key").agg(F.count("*").alias("rows"))
    chosen = cut(best.select(F.col("best.key").alias("key")).join(rows, "key").withColumnRenamed("key", key))
    found = docs.where(worded).withColumn(key, _row_key())
    kept = found.join(chosen.where("rows = 1").select(key), key, "left_semi")
    once = found.join(chosen.where("rows > 1").select(key), key, "left_semi").dropDuplicates([key])
    return kept.unionByName(once).select(docs.columns).unionByName(docs.where(~worded))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that share a window of words with a benchmark item. Null texts stay."""
    key = _fresh(docs, "key")
    found = decontam.contaminated(docs.select(_row_key().alias(key), "text"), table(spark, sf_dir, "benchmark"), id_col=key)
    bad = found.where("contaminated").select(key).distinct()
    return docs.withColumn(key, _row_key()).join(bad, key, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it; documents it doesn't take go. Documents
    without words have no size to balance and stay as they are. Rows with one id and one text
    are taken as one row with their copies together. An empty table stays empty."""
    key, copies, copy = _fresh(docs, "key"), _fresh(docs, "copies"), _fresh(docs, "copy")
    mixed = mixing.mix(docs.select(_row_key().alias(key), "text", "source"), id_col=key)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(1))
    counted = mixed.groupBy(key).agg(F.sum(times).cast("int").alias(copies)).where(F.col(copies) > 0)
    taken = docs.withColumn(key, _row_key()).join(counted, key).dropDuplicates([key])
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes, copies of a text together. Null and empty texts have size 1; an empty
    table gives no rows."""
    return sharding.minimax_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: SQL can express neither the fitted model nor XXH64; tests compare with plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    folder = files.shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
        return cut(docs)
    finally:
        files.remove(spark, folder)
