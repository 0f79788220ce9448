"""At a cosine whose bound reaches most lists, queries go to few long lists, and links are those of brute force."""

import numpy as np
import pytest

from tallyloom.llm import quantised


@pytest.mark.parametrize("spread", [3.0, 0.2])
def test_wide_queries_are_sent_to_few_lists(spark, monkeypatch, spread):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(20, 16))[rng.integers(0, 20, 600)] + spread * rng.normal(size=(600, 16))
    points[300:310] = points[:10]
    labels = [None if k % 97 == 0 else k % 2 for k in range(600)]
    sent, store = [], quantised.cut
    monkeypatch.setattr(quantised, "cut", lambda df: (made := store(df), sent.append(made.count()) if "held" in made.columns else None)[0])
    table = spark.createDataFrame([(k, points[k].tolist(), labels[k]) for k in range(600)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in quantised.embedding_groups(table, cosine=0.4, rows_per_list=8, tile=32, deviations=None).collect()}
    assert sent and sent[0] < 600 * 10  # short lists: 600 times most of 38
    unit = points / np.sqrt((points**2).sum(1))[:, None]
    links = (unit @ unit.T >= 0.4) & np.array([[a is not None and a == b for b in labels] for a in labels])
    np.fill_diagonal(links, False)
    root = np.arange(600)
    while (new := np.minimum(root, np.where(links, root[None, :], 600).min(1))).tolist() != root.tolist():
        root = new
    assert got == {k: (int(links[k].sum()), int(root[k])) for k in range(600)}


def test_narrow_queries_keep_short_lists():
    rng = np.random.default_rng(6)
    points = np.repeat(rng.normal(size=(400, 32)), 4, axis=0)
    points /= np.sqrt((points**2).sum(1))[:, None]
    made = quantised._fitted(points, 100, 1, 0.05)
    assert made.bits == 8 and 80 <= made.starts()[-1] <= 120  # shares of centres are rounded
