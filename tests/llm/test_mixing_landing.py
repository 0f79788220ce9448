"""Sources of many chunks, and small ones beside them, land on their targets."""

import random

from tallyloom.llm import mixing


def test_landing_beside_a_large_source(spark):
    rng = random.Random(11)
    rows = []
    for source, n in (("a", 900), ("b", 30), (None, 120)):
        rows += [(len(rows) + k, "w " * min(3000, int(rng.lognormvariate(4, 1.2)) + 1), source) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, chunk=50).collect()
    home, taken, target = {r[0]: r[2] for r in rows}, {}, {}
    assert sorted(r.doc_id for r in found) == sorted(home)
    for r in found:
        taken[home[r.doc_id]] = taken.get(home[r.doc_id], 0) + r.taken
        target[home[r.doc_id]] = r.target
    print({s: (taken[s], target[s]) for s in target})
    assert all(abs(taken[s] - target[s]) <= 3 for s in target)
