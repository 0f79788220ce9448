"""bootstrap_ci takes every neighbouring pair, and all replicates."""

import os

import pytest

from tallyloom.operators import similarity
from tallyloom.plans import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_bootstrap_ci(spark, monkeypatch):
    real, seen = similarity.bootstrap, {}

    def watched(cosines, replicates=similarity.REPLICATES, *rest, **more):
        seen.update(pairs=cosines.where("side = 'substitute'").count(), replicates=replicates)
        return real(cosines, replicates, *rest, **more)

    monkeypatch.setattr(similarity, "bootstrap", watched)
    found = queries.QUERIES["bootstrap_ci"](spark, DATA).first()
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    print(seen)
    assert seen == {"pairs": table.count() - table.select("label").distinct().count(), "replicates": 10_000}
    assert found.ci_low <= found.lift <= found.ci_high
