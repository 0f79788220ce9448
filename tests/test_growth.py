"""What a task or the driver holds doesn't grow with the tables."""

import inspect
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.functions import lineage
from tallyloom.operators import cooccurrence as C
from tallyloom.operators import encoder, examples, similarity, training
from tallyloom.plans import gate_queries, gates, source_queries
from tallyloom.sources import readers

DATA = "/root/testdata/sf0.001"


def tasks(df):
    return df.rdd.getNumPartitions()


def test_tasks_grow_with_pairs(spark, monkeypatch):
    monkeypatch.setattr(lineage, "PER_TASK", 40)
    made = [(b, f"i{(b * 5 + j * j) % 23}") for b in range(60) for j in range(6)]
    counts = C.cooccurrence(spark.createDataFrame(made, "basket long, item string"))
    baskets = {}
    for b, i in made:
        baskets.setdefault(b, set()).add(i)
    assert {(r.a, r.b): r.n for r in counts.collect()} == Counter(p for own in baskets.values() for p in combinations(sorted(own), 2))
    assert tasks(counts) >= 20 and tasks(C.ppmi(counts)) >= 4
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


@pytest.mark.parametrize("most", [C.TILE, 3])
def test_rows_are_dealt_before_they_are_made_distinct(spark, monkeypatch, most):
    monkeypatch.setattr(C, "TILE", most)
    monkeypatch.setattr(lineage, "PER_TASK", 40)
    plans, store = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or store(df))
    made = [(b, f"i{(b * 5 + j * j) % 23}") for b in range(60) for j in range(6)]
    frame = spark.createDataFrame([*made, *made, (1, None)], "basket long, item string")
    counts = C.cooccurrence(frame)
    distinct = next(p for p in plans if "keys=[basket" in p)
    assert distinct.rindex("keys=[basket") < distinct.rindex("Exchange hashpartitioning(basket")
    baskets = {b: {i for c, i in made if c == b} for b in range(60)}
    assert {(r.a, r.b): r.n for r in counts.collect()} == Counter(p for own in baskets.values() for p in combinations(sorted(own), 2))


def test_texts_of_one_file_go_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(encoder, "PER_TASK", 500)
    texts = spark.createDataFrame([(k, f"some {k % 7} words of {k}") for k in range(90)], "item long, text string").coalesce(1)
    found = encoder.encode(texts, dimensions=16)
    assert tasks(found) >= 5 and found.count() == 90


def test_divergent_pairs_stay_out_of_the_driver(spark, monkeypatch):
    most, rows = [], gates._rows
    monkeypatch.setattr(gates, "_rows", lambda df: most.append(rows(df)) or most[-1])
    assert gate_queries.divergence_gate(spark, DATA).count() == 3
    assert max(map(len, most)) <= 3


def test_long_texts_and_vectors_are_not_broadcast(spark):
    texts = spark.createDataFrame([(k, f"t{k}") for k in range(9)], "item long, text string")
    pairs = spark.createDataFrame([(k, k, k + 1) for k in range(8)], "ordinal long, a long, b long")
    made = examples.training_examples(pairs, pairs, texts)
    vectors = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(9)], "item long, vector array<double>")
    for df in (made.select("anchor", "positive"), training.with_vectors(made.select("ordinal", "anchor", "positive"), texts, vectors)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert training.with_vectors(made, texts, vectors).count() == made.count() == 8


@pytest.mark.parametrize("arm", ["2b", "2c", "2d"])
def test_rungs_with_sql_take_all_positives(spark, monkeypatch, arm):
    signature, asked = inspect.signature(gates.run_arm), {}

    def run_arm(*args, **named):
        asked.update(signature.bind(*args, **named).arguments)
        raise StopIteration

    monkeypatch.setattr(gates, "run_arm", run_arm)
    with pytest.raises(StopIteration):
        gate_queries._arm(spark, DATA, arm)
    assert not asked.get("most", gates.MOST)


def test_files_in_order_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(lineage, "PER_TASK", 100)
    rows = spark.range(1000).repartition(3)
    found = source_queries._ordered(rows, 1000, "id")
    assert tasks(found) == 10 and [r.id for r in found.collect()] == list(range(1000))


@pytest.mark.parametrize("limit", [1, 3, 7, 50])
def test_first_baskets_in_several_looks(spark, monkeypatch, tmp_path, limit):
    monkeypatch.setattr(readers, "AHEAD", 1)
    decks = [k // 9 if k < 45 else (k * 7) % 11 for k in range(90)]
    spark.createDataFrame([(str(d) if d != 3 else None, f"i{k}", "x", True) for k, d in enumerate(decks)], "deck_id string, oracle_id string, commander_name string, temporally_valid boolean").coalesce(1).write.parquet(f"{tmp_path}/rows")
    first = [*dict.fromkeys(decks)][:limit]
    found = readers.fixed_baskets(spark, f"{tmp_path}/rows", limit)
    assert {(r.basket, r.item) for r in found.collect()} == {(f"precon:{d}", f"i{k}") for k, d in enumerate(decks) if d in first and d != 3}
    plan = readers.fixed_baskets(spark, f"{tmp_path}/rows", limit)._jdf.queryExecution().optimizedPlan().toString()
    assert "min(ordinal" not in plan  # no aggregate of all rows


@pytest.mark.parametrize("n", [1, 5, 3000])
def test_weights_by_additions(n):
    rng = np.random.default_rng(n)
    x, y, values = rng.integers(0, similarity.PRIME, n), rng.integers(0, similarity.PRIME, n), rng.random(n)
    x[0] = y[0] = similarity.PRIME - 1
    batch = pa.RecordBatch.from_arrays([pa.array(["random"] * n), pa.array(x), pa.array(y), pa.array(values)], ["side", "x", "y", "cosine"])
    (found,) = similarity._weighed(131)(iter([batch]))
    w = sum(((x[:, None] * np.arange(131) + y[:, None]) % similarity.PRIME >= c).astype(int) for c in similarity.CUTS)
    assert found.column("n").to_pylist() == w.sum(axis=0).tolist() and np.allclose(found.column("s"), values @ w)


def test_values_of_the_bootstrap_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PER_TASK", 50)
    rows = [(s, f"p{k}", str(k), str(k + 1), k / 200) for k in range(100) for s in ("substitute", "random")]
    cosines = spark.createDataFrame(rows, "side string, pair string, a string, b string, cosine double").coalesce(1)
    sums, dealt = similarity._weighed, []
    monkeypatch.setattr(similarity, "_weighed", lambda replicates: sums(replicates))
    frame = type(cosines)
    made = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *args, **named: dealt.append(tasks(self)) or made(self, *args, **named))
    assert similarity.bootstrap(cosines, 100).first()["lift"] is not None and dealt == [4]
