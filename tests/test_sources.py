"""Readers, sinks and merged findings on small files."""

import csv
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import gates
from tallyloom.sources import readers, sinks


def lines(path, rows):
    opened = gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")
    with opened as out:
        out.writelines(r if isinstance(r, str) else json.dumps(r) + "\n" for r in rows)
    return str(path)


@pytest.fixture(scope="module")
def snapshot(spark, tmp_path_factory):
    path = lines(tmp_path_factory.mktemp("s") / "items.jsonl.gz", [{"oracle_id": "1", "name": "Old"}, {"oracle_id": "", "name": "none"}, {"oracle_id": "2", "name": "Fire // Ice"}, "not json\n", {"oracle_id": "1", "name": "Bolt"}])
    return readers.item_snapshot(spark, path)


def test_snapshot_keeps_last(snapshot):
    assert sorted((r.item, r.name) for r in snapshot.collect()) == [("1", "Bolt"), ("2", "Fire // Ice")]


def test_named_baskets(spark, snapshot, tmp_path):
    path = lines(tmp_path / "decks.jsonl", [{"deck_id": 1, "commander": "C", "card_names": ["bolt", "Bolt", "fire"], "created_at": "2026-01-01"}, {"deck_id": 2, "card_names": []}, {"deck_id": 3, "card_names": ["nobody"]}, {"deck_id": 4, "card_names": ["Ice", "Fire // Ice"]}])
    baskets, resolved = readers.named_baskets(spark, path, snapshot)
    assert sorted((r.basket, r.item) for r in baskets.collect()) == [("archidekt:1", "1"), ("archidekt:1", "2"), ("archidekt:4", "2")]
    assert resolved.count() == 6
    assert {r.basket for r in readers.named_baskets(spark, path, snapshot, limit=1)[0].collect()} == {"archidekt:1"}


def test_pair_tables(spark, tmp_path):
    rows = [("d1", "x", None, "edhtop16", True), ("d1", "y", "Cmd", "edhtop16", True), ("d1", "z", "Late", "edhtop16", None), ("d2", "x", "C", "other", True), ("d3", None, "C", "edhtop16", True), ("d4", "x", "C4", "edhtop16", False), ("d5", "q", "C5", "edhtop16", True)]
    spark.createDataFrame(rows, "deck_id string, oracle_id string, commander_name string, source string, temporally_valid boolean").coalesce(1).write.parquet(str(tmp_path / "t"))
    found = readers.corpus("cedh")(spark, str(tmp_path / "t"))
    assert sorted((r.basket, r.commander, r.item) for r in found.collect()) == [("edhtop16:d1", "Cmd", "x"), ("edhtop16:d1", "Cmd", "y"), ("edhtop16:d5", "C5", "q")]
    assert {r.basket for r in readers.corpus("cedh")(spark, str(tmp_path / "t"), limit=3).collect()} == {"edhtop16:d1"}
    assert {r.basket for r in readers.corpus("precon")(spark, str(tmp_path / "t")).collect()} == {"precon:d1", "precon:d2", "precon:d5"}
    with pytest.raises(ValueError):
        readers.corpus("else")


def test_tags_printings_and_pairs(spark, snapshot, tmp_path):
    tags = lines(tmp_path / "tags.jsonl", [
        {"slug": "draw", "taggings": [{"oracle_id": "1"}]}, {"slug": "draw", "taggings": [{"oracle_id": "1"}, {"oracle_id": "2"}, {"oracle_id": "2"}]},
        {"slug": "literal", "taggings": "[{'oracle_id': '1'}, {'oracle_id': '3'}]"}, {"slug": "broken", "taggings": "[{'oracle_id'"}, {"slug": "typal-elf", "taggings": [{"oracle_id": "1"}, {"oracle_id": "2"}]}, {"slug": "", "taggings": []}])
    assert sorted(tuple(r) for r in readers.tags(spark, tags).collect()) == [("draw", "1"), ("draw", "2"), ("literal", "1"), ("literal", "3")]
    printed = lines(tmp_path / "all.json", ["[\n", '{"oracle_id": "1", "name": "Bolt", "printed_text": "a"},\n', "{broken,\n", '{"oracle_id": "1", "name": "Bolt", "printed_text": "b"}\n', "]\n"])
    assert sorted(r.printed_text for r in readers.printings(spark, printed).collect()) == ["a", "b"]
    path = tmp_path / "pairs.csv"
    with path.open("w", newline="") as out:
        csv.writer(out).writerows([["card_a", "card_b", "role"], ["Bolt", "Fire // Ice", "r, s"]])
    known = snapshot.withColumn("ordinal", F.lit(0))
    assert [tuple(r) for r in readers.eval_pairs(spark, str(path), known).collect()] == [("1", "2")]
    with path.open("a", newline="") as out:
        csv.writer(out).writerow(["Bolt", "Gone", ""])
    with pytest.raises(ValueError, match="Gone"):
        readers.eval_pairs(spark, str(path), known)


def test_sinks_and_manifest(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("a,b", 1)], "x string, y int"), str(tmp_path / "out"), one_file=True)
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()] == [("a,b", "1")]
    file = tmp_path / "f"
    file.write_bytes(b"abc")
    found = sinks.manifest(spark, [str(file), str(tmp_path / "out"), str(tmp_path / "no")])
    assert found[str(file)]["sha256"] == hashlib.sha256(b"abc").hexdigest() and found[str(file)]["bytes"] == 3
    assert found[str(tmp_path / "out")]["is_dir"] and found[str(tmp_path / "no")] == {"exists": False}
    queue = sinks.review_queue(spark.createDataFrame([("1", "2", "draw", 3)], "a string, b string, slug string, n int"), spark.createDataFrame([("1", "A"), ("2", "B")], "item string, name string")).first()
    assert tuple(queue) == ("", "A", "B", "draw (n=3)", "1", "2")
    gates.report(spark, str(tmp_path / "findings"), "t0", {"strata": [{"stratum": "all", "coverage": 0.5}]}, sinks.table([{"stratum": "all", "coverage": 0.5}]), [str(file)])
    written = json.loads((tmp_path / "findings" / "t0.json").read_text())
    assert written["thresholds"]["t0"]["pass"] == 0.85 and written["inputs"][str(file)]["exists"]
    assert "50.0%" in (tmp_path / "findings" / "t0.md").read_text()


def test_merge(spark, tmp_path):
    part = lambda arm, corpus, **more: {"arm": arm, "corpus": corpus, "curated": {"mean_substitute_cosine": 0.72, "mean_random_cluster_cosine": 0.75}, **more}
    (tmp_path / "t2_leakage_partial_a.json").write_text(json.dumps({"results": [part("2a", "precon")]}))
    (tmp_path / "t2_leakage_partial_b.json").write_text(json.dumps({"results": [part("2b", "casual", n_total=5)]}))
    merged = gates.merge_files(spark, str(tmp_path))
    assert [(r["arm"], r["corpus"]) for r in merged["results"]] == [("2a", "precon"), ("2b", "casual")] and merged["harness"]["matches_reference"]
    (tmp_path / "t2_leakage_partial_d.json").write_text(json.dumps({"results": [part("2c", "cedh", lift=float("nan"), ends=[float("-inf"), 1.5])]}, indent=2))
    odd = gates.merge_files(spark, str(tmp_path))["results"][-1]
    assert odd["lift"] is None and odd["ends"] == [None, 1.5]
    (tmp_path / "t2_leakage_partial_e.json").write_text("{")
    with pytest.raises(ValueError, match="not JSON"):
        gates.merge_files(spark, str(tmp_path))
    (tmp_path / "t2_leakage_partial_e.json").unlink()
    (tmp_path / "t2_leakage_partial_c.json").write_text(json.dumps({"results": [part("2b", "casual")]}))
    with pytest.raises(ValueError, match="casual"):
        gates.merge_files(spark, str(tmp_path))
    one = spark.createDataFrame([("2a", "x")], "arm string, corpus string")
    with pytest.raises(ValueError):
        gates.merge_results([one, one])
