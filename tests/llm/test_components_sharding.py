import random

import pytest

from tallyloom.llm import sharding
from tallyloom.llm.components import components
from tallyloom.llm.mixing import flight


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)],
    [(k, 1000 - k) for k in range(300)] + [(5, 700), (3, 9), (3, 9)],
    [],
])
def test_components(spark, edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def greedy(ends, capacity, shards):
    cuts, at = [], 0
    for _ in range(shards):
        at = max([at, *(e for e in ends if e <= at + capacity)])
        cuts.append(at)
    return cuts


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_least(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 1, 2, 5, 30, 200 if seed % 2 else 7]) for _ in range(rng.randint(1, 120))]
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    total, largest, shards = ends[-1], max(sizes), rng.choice([1, 3, 8])
    best = next(c for c in range(largest, total + 1) if greedy(ends, c, shards)[-1] == total)
    table = spark.createDataFrame([(e,) for e in ends], "end long")
    for detail in (4, 1 << 15):
        assert sharding.capacity_cuts(table, total, largest, shards, detail) == greedy(ends, best, shards)


def test_cuts_beyond_the_digest(spark):
    ends = [1000, 1003, 5000, 5001, 9000, 9900, 9950, 12_000]
    table = spark.createDataFrame([(e,) for e in ends], "end long")
    best = next(c for c in range(3997, 12_001) if greedy(ends, c, 3)[-1] == 12_000)
    assert sharding.capacity_cuts(table, 12_000, 3997, 3, 2, 2) == greedy(ends, best, 3)


def test_shards_of_documents(spark):
    import zlib

    texts = ["same" * 5] * 30 + [None, None, "", "é"] + [f"text {i} " * (i % 17) for i in range(300)] + ["x" * 900]
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in enumerate(texts)] + [(3, texts[3], 1, "b"), (None, "no id", 1, "c")], "doc_id long, text string, size long, slot string")
    found = sharding.minimax_shards(docs, 8).collect()
    assert len(found) == len(texts) + 2 and {r.law for r in found} == {"bytes"}
    for r in found:
        text = "no id" if r.doc_id is None else texts[r.doc_id]
        assert r["size"] == len((text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text or "").encode()) and r.grown_shard is None
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())
    assert all(len({r.shard for r in found if r.doc_id is not None and texts[r.doc_id] == t}) == 1 for t in set(texts))
    groups, sizes = {}, []
    for r in found:
        text = "no id" if r.doc_id is None else texts[r.doc_id]
        groups.setdefault(text, []).append(r)
    firsts = sorted((min(-1 if r.doc_id is None else r.doc_id for r in rows), sum(r["size"] for r in rows)) for rows in groups.values())
    ends = [sum(s for _, s in firsts[: k + 1]) for k in range(len(firsts))]
    sizes = [s for _, s in firsts]
    best = next(c for c in range(max(sizes), ends[-1] + 1) if greedy(ends, c, 8)[-1] == ends[-1])
    assert max(sum(r["size"] for r in rows) for rows in by.values()) <= best
    assert sharding.minimax_shards(docs.limit(0)).count() == 0


def test_flight_keeps_totals():
    rng = random.Random(1)
    sizes = [rng.randint(1, 50) for _ in range(200)] + [7, 7, 7]
    moved = flight(sizes, [0.37] * 203, "key")
    assert sum(1 for p in moved if 0 < p < 1) <= 2
    assert abs(sum(moved) - 0.37 * 203) < 1e-6 and abs(sum(s * p for s, p in zip(sizes, moved)) - 0.37 * sum(sizes)) < 1e-5
