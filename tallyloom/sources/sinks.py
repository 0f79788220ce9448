"""Where results go: CSV, findings as JSON and Markdown, and a manifest of inputs."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which an input file is hashed.
HASH_LIMIT = 64 << 20


def write_csv(rows: DataFrame, path: str, one_file: bool = False) -> None:
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).csv(path)


def review_queue(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """Candidates as a table to be filled in by hand: an empty `keep`, names, the tag, ids."""
    left, right = names.select(F.col("item").alias("a"), F.col("name").alias("card_a")), names.select(F.col("item").alias("b"), F.col("name").alias("card_b"))
    note = F.format_string("%s (n=%d)", "slug", "n")
    return candidates.join(left, "a").join(right, "b").select(F.lit("").alias("keep"), "card_a", "card_b", note.alias("shared_tag"), F.col("a").alias("oracle_id_a"), F.col("b").alias("oracle_id_b"))


def manifest(spark: SparkSession, paths: list[str]) -> dict[str, dict]:
    """Of each input whether it is there, its files, bytes, and time or SHA-256 of a small file.

    Files are listed and hashed by Spark, so any store it reads will do."""
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), {}
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(conf)
        if not store.exists(at):
            found[path] = {"exists": False}
            continue
        status = store.getFileStatus(at)
        if status.isDirectory():
            summary = store.getContentSummary(at)
            found[path] = {"exists": True, "is_dir": True, "file_count": summary.getFileCount(), "bytes": summary.getLength()}
            continue
        found[path] = {"exists": True, "bytes": status.getLen(), "mtime": status.getModificationTime() // 1000}
        if status.getLen() <= HASH_LIMIT:
            found[path]["sha256"] = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    return found


def _git(*words: str) -> str | None:
    done = subprocess.run(["git", *words], capture_output=True, text=True, check=False)
    return done.stdout.strip() if done.returncode == 0 else None


def envelope(spark: SparkSession, inputs: list[str], thresholds: dict, run_args: dict | None = None) -> dict:
    status = _git("status", "--porcelain")
    return {"git_rev": _git("rev-parse", "HEAD"), "git_dirty": None if status is None else bool(status), "thresholds": thresholds, "inputs": manifest(spark, inputs), "run_args": run_args or {}}


def write_text(spark: SparkSession, path: str, body: str) -> None:
    """A small file, in any store that Spark writes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()


def write_findings(spark: SparkSession, folder: str, name: str, payload: dict, markdown: str) -> tuple[str, str]:
    """The findings, small by then, as JSON with sorted keys and as Markdown."""
    as_json, as_text = f"{folder}/{name}.json", f"{folder}/{name}.md"
    write_text(spark, as_json, json.dumps(payload, indent=2, sort_keys=True, default=str) + "\n")
    write_text(spark, as_text, markdown)
    return as_json, as_text


def percent(value: float | None) -> str:
    return "—" if value is None else f"{100 * value:.1f}%"


def table(rows: list[dict]) -> str:
    """Rows as a Markdown table."""
    if not rows:
        return ""
    head = list(rows[0])
    shown = lambda v: percent(v) if isinstance(v, float) and 0 <= v <= 1 else str(v)
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "-|" * len(head), *("| " + " | ".join(shown(r[k]) for k in head) + " |" for r in rows)]) + "\n"
