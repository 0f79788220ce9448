"""The gates and the builder from files, as a user runs them."""

import csv
import inspect
import json

import pytest

from tallyloom.__main__ import arguments, main
from tallyloom.operators.parsers import Parser, ParserUnavailable
from tallyloom.plans import gates

PARSER = '''
import json

def encode(line):
    card = json.loads(line)
    if "broken" in card["oracle_text"]:
        raise ValueError("no grammar")
    gap = "  # SPEC_GAP: cost: unknown\\n" if "costs" in card["oracle_text"] else ""
    return "CARD {\\n  NAME: \\"%s\\"\\n%s  DRAW { %s }\\n}" % (card["name"], gap, card["oracle_text"].replace(",", ""))

def exclude(line):
    return "token" if "Token" in json.loads(line)["type_line"] else None
'''


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    texts = ["draw 1", "draw 2", "draw one card and keep it for later", "draw one card and keep it for later", "costs less", "broken", "land", "draw 3"]
    items = [(f"c{k}", f"Card {k}", texts[k % 8] + ("" if k % 8 in (2, 3) else f" of {k % 8} longer words"), "Basic Land" if k % 8 == 6 else "Token" if k == 7 else "Instant", float(k % 4), ["W"] if k % 2 else ["U"]) for k in range(40)]
    spark.createDataFrame(items, "oracle_id string, name string, oracle_text string, type_line string, cmc double, color_identity array<string>").coalesce(1).write.parquet(f"{top}/cards")
    (top / "snapshot.jsonl").write_text("".join(json.dumps({"oracle_id": i, "name": n, "oracle_text": t, "type_line": y}) + "\n" for i, n, t, y, _, _ in items))
    decks = [{"deck_id": str(d), "commander": "x", "card_names": [f"Card {(d * 3 + j * j) % 40}" for j in range(6)]} for d in range(60)]
    (top / "casual.jsonl").write_text("".join(json.dumps(d) + "\n" for d in decks))
    spark.createDataFrame([(str(d), f"c{(d * 3 + j * j) % 40}", "x", True) for d in range(60) for j in range(6)], "deck_id string, oracle_id string, commander_name string, temporally_valid boolean").coalesce(1).write.parquet(f"{top}/precon")
    with (top / "pairs.csv").open("w", newline="") as out:
        csv.writer(out).writerows([["card_a", "card_b", "role"], ["Card 0", "Card 1", "draw"], ["Card 26", "Card 27", "same"], ["Card 9", "Gone", "lost"]])
    with (top / "eval.csv").open("w", newline="") as out:
        csv.writer(out).writerows([["card_a", "card_b", "role"], ["Card 0", "Card 8", "draw"], ["Card 1", "Card 9", "draw"]])
    spark.createDataFrame([(f"c{k}", k % 3) for k in range(40)], "oracle_id string, cluster int").write.parquet(f"{top}/clusters")
    spark.createDataFrame([(f"c{k}", [float((k * j) % 7) / 13 for j in range(1, 5)]) for k in range(40)], "item string, vector array<double>").write.parquet(f"{top}/vectors")
    (top / "tags.jsonl").write_text(json.dumps({"slug": "draws", "taggings": [{"oracle_id": f"c{k}"} for k in (0, 1, 8)]}) + "\n")
    (top / "grammar").mkdir()
    (top / "grammar" / "cardgrammar.py").write_text(PARSER)
    return top


def with_parser(top):
    return ["--parser", f"{top}/grammar", "--encode", "cardgrammar:encode", "--exclude", "cardgrammar:exclude", "--snapshot", f"{top}/snapshot.jsonl"]


def test_coverage(spark, files, tmp_path):
    words = ["coverage", "--items", f"{files}/cards", "--corpus", f"casual={files}/casual.jsonl", f"precon={files}/precon", "--findings", str(tmp_path), *with_parser(files)]
    assert main(words, spark) == 0
    found = json.loads((tmp_path / "t0_coverage.json").read_text())["results"]
    assert set(found) == {"casual", "precon"} and found["casual"]["n_baskets"] == found["precon"]["n_baskets"] == 60
    assert found["casual"]["strata"] == found["precon"]["strata"]
    failed = spark.read.option("header", True).csv(found["casual"]["failures"]["path"])
    assert failed.columns == ["oracle_id", "name", "type_line", "appearances", "status", "gap_category", "exclusion_reason", "error"]
    assert {(r.status, r.exclusion_reason or r.gap_category or r.error) for r in failed.collect()} == {("gap", "cost"), ("crash", "ValueError: no grammar"), ("excluded", "token")}
    assert "## casual" in (tmp_path / "t0_coverage.md").read_text()
    assert main([*words, "--smoke"], spark) == 0 and json.loads((tmp_path / "smoke" / "t0_coverage.json").read_text())["run_args"]["limit"] == 200


def test_divergence(spark, files, tmp_path):
    words = ["divergence", "--items", f"{files}/cards", "--pairs", f"same_effect_wording={files}/pairs.csv", "--findings", str(tmp_path), *with_parser(files)]
    assert main(words, spark) == 0
    found = json.loads((tmp_path / "t1_divergence.json").read_text())
    sets = {s["tier"]: s for s in found["sets"]}
    assert sets["same_effect_wording"]["n_pairs"] == 2 and sets["same_effect_wording"]["clean_rules_loose"] == 0.5
    assert sets["numeric"]["clean_rules_loose"] == 0.0 and "Gone" in found["skips"]["same_effect_wording (names without item)"]
    logged = [tuple(r) for r in spark.read.option("header", True).csv(found["divergent"]["path"]).collect()]
    assert [r[:4] for r in logged] == [("same_effect_wording", "Card 0", "Card 1", "draw")] and all(r[4] != r[5] for r in logged)
    assert "Verdict: " in (tmp_path / "t1_divergence.md").read_text()


def test_wordings_are_scored(spark, files, tmp_path):
    """Two wordings of one item are parsed each, and compared with each other."""
    printed = [("c0", "draw 1 of 0 longer words"), ("c0", "draw one card"), ("c1", "draw 2"), ("c1", "draw  2"), ("c2", "keep it"), ("c2", "keep that"), ("gone", "x y"), ("gone", "z")]
    lines = [json.dumps({"oracle_id": i, "name": i, "printed_text": t}) for i, t in printed]
    (tmp_path / "all.json").write_text("[\n" + ",\n".join(lines) + "\n]\n")
    words = ["divergence", "--items", f"{files}/cards", "--printings", f"{tmp_path}/all.json", "--findings", str(tmp_path), *with_parser(files)]
    assert main(words, spark) == 0
    found = json.loads((tmp_path / "t1_divergence.json").read_text())
    sets = {s["tier"]: s for s in found["sets"]}
    assert "reprints" not in found["skips"] and (sets["reprints"]["n_pairs"], sets["reprints"]["n_both_clean"], sets["reprints"]["clean_rules_loose"]) == (3, 2, 1.0)
    assert sets["identical_text"]["n_pairs"] > 0 and sets["identical_text"]["clean_rules_loose"] == 0.0


def test_leakage_and_merge(spark, files, tmp_path):
    words = ["leakage", "--items", f"{files}/cards", "--eval-pairs", f"{files}/eval.csv", "--clusters", f"{files}/clusters", "--vectors", f"{files}/vectors", "--findings", str(tmp_path), "--smoke"]
    assert main([*words, "--corpus", f"precon={files}/precon", "--tag", "a"], spark) == 0
    assert main([*words, "--corpus", f"casual={files}/casual.jsonl", "--arms", "2c", "--tag", "b"], spark) == 0
    one = json.loads((tmp_path / "t2_leakage_partial_b.json").read_text())
    assert [(r["arm"], r["corpus"]) for r in one["results"]] == [("2c", "casual")] and one["results"][0]["n_positives_mined"] <= 200
    assert main(["leakage", "--merge", "--findings", str(tmp_path)], spark) == 0
    merged = json.loads((tmp_path / "t2_leakage.json").read_text())
    assert [(r["arm"], r["corpus"]) for r in merged["results"]] == [("2a", "precon"), ("2c", "casual")]
    assert "| 2a | precon |" in (tmp_path / "t2_leakage.md").read_text()
    assert {r["verdict"] for r in merged["results"]} == {"NOT_TRAINED"}


def test_rungs_that_are_trained_differ(spark, files, tmp_path):
    words = ["leakage", "--items", f"{files}/cards", "--eval-pairs", f"{files}/eval.csv", "--clusters", f"{files}/clusters", "--findings", str(tmp_path), "--smoke"]
    assert main([*words, "--corpus", f"casual={files}/casual.jsonl", "--arms", "2b", "2c", "2d"], spark) == 0
    found = {r["arm"]: r for r in json.loads((tmp_path / "t2_leakage.json").read_text())["results"]}
    assert list(found) == ["2b", "2c", "2d"] and len({r["mined_holdout"]["mean_substitute_cosine"] for r in found.values()}) == 3
    assert all(r["verdict"] != "NOT_TRAINED" for r in found.values())


def test_probes(spark, files, tmp_path, capsys):
    assert main(["probes", "--items", f"{files}/cards", "--pairs", f"substitutes={files}/eval.csv", f"same_effect_diff_wording={files}/pairs.csv", "--tags", f"{files}/tags.jsonl", "--out", str(tmp_path)], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["substitutes"]["n_written"] == 2 and found["same_effect_diff_wording"]["missing_names"] == ["Gone"]
    assert found["demoted_to_identical_text"] == ["Card 26 / Card 27"] and found["same_effect_diff_wording"]["n_written"] == 1
    read = lambda name: spark.read.option("header", True).csv(found[name]["path"])
    assert read("identical_text").columns == ["card_a", "card_b", "role"] and read("identical_text").count() == found["identical_text"]["n_written"] > 5
    assert read("tag_candidates").columns == ["keep", "card_a", "card_b", "shared_tag", "oracle_id_a", "oracle_id_b"]


def test_parsers(tmp_path, files, spark):
    assert not Parser(None).available and not Parser(str(tmp_path / "no")).available
    (tmp_path / "emptygrammar.py").write_text("")
    with pytest.raises(ParserUnavailable, match="has no encode"):
        Parser(str(tmp_path), "emptygrammar:encode").ensure()
    assert Parser(f"{files}/grammar", "cardgrammar:encode").describe().startswith("cardgrammar:encode@")
    assert main(["coverage", "--items", f"{files}/cards", "--parser", str(tmp_path), "--encode", "nothing:encode"], spark) == 2


def test_thresholds(tmp_path):
    assert main(["thresholds"]) == 0
    (tmp_path / "t.md").write_text("85% 70% 10% 25% 5% 95% 0.717")
    assert main(["thresholds", "--document", str(tmp_path / "t.md")]) == 1
    assert [p.split(" (")[0] for p in gates.out_of_sync((tmp_path / "t.md").read_text())] == ["t0 guard", "t2 lift", "t2 random"]


def test_positives_are_capped_by_default():
    assert gates.MOST == 250_000 == arguments(["leakage"]).max_positives
    assert inspect.signature(gates.run_arm).parameters["most"].default == gates.MOST
