"""Near-duplicates of the pipeline against exact Jaccard similarity of all pairs."""

import os
import random

import pytest

import corpus_pipeline
from tallyloom.llm import neardup, simhash

DATA = "/root/testdata/sf0.001"


def shingled(text):
    words = [w.lower() for w in text.encode().split()]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def expected(texts):
    """The least number of each text's group."""
    sets, root = [shingled(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for b in range(len(sets)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(texts))]


def test_groups(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 5000)}"
    texts = ["one", "ONE ", "two  words", "two words", "two words more"]
    for n in (6, 30, 120, 400, 5000):
        for change in (1, 2, 3, 5, 8, 20):
            base = [word() for _ in range(n)]
            near = list(base)
            for k in rng.sample(range(n), min(n, change * n // 300 + 1)):
                near[k] = word()
            texts += [" ".join(base), "\t".join(near)]
    base = [word() for _ in range(150)]  # one bucket of many members, near and not near
    for k in range(700):
        copy = list(base)
        for at in rng.sample(range(150), rng.choice((1, 2, 9))):
            copy[at] = word()
        texts.append(" ".join(copy))
    got = dict(simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    want = expected(texts)
    assert [got[k] for k in range(len(texts))] == want
    assert len(set(want)) < 300


def test_a_large_bucket_without_a_centre(spark, monkeypatch):
    """5,000 members of one family that are not similar but for planted pairs: no pair of a bucket of thousands is
    left out, whatever blocks they fall into."""
    monkeypatch.setattr(neardup, "_VOLUME", 1 << 18)
    rng = random.Random(5)
    base, texts, used = [f"b{k}" for k in range(294)], [], set()
    while len(texts) < 5000:
        # a word changes five of 290 shingles, none of them twice: pairs share 260 of 320, others 225 of 355 at most
        places = rng.sample(range(5, 289, 6), 9)
        ours = [frozenset(places[:3] + mine) for mine in (places[3:6], places[6:])]
        if used & set(ours):
            continue
        used |= set(ours)
        for own in ours:
            copy = list(base)
            for at in own:
                copy[at] = f"x{len(texts) // 2 if at in places[:3] else 10_000 + len(texts)}.{at}"
            texts.append((len(texts), " ".join(copy)))
    rng.shuffle(texts)
    got = dict(simhash.near_groups(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect())
    assert got == {k: k - k % 2 for k, _ in texts}


def test_a_family_of_copies_is_dealt_a_few_times(spark, monkeypatch):
    """A near copy shares most of 32 buckets with its family: it lies in blocks of a few of them, and all are one group."""
    dealt, linked = [], neardup.linked_blocks
    monkeypatch.setattr(neardup, "linked_blocks", lambda blocks, *more: dealt.append(blocks.groupBy("node").count().agg({"count": "max"}).first()[0]) or linked(blocks, *more))
    base = [f"b{k}" for k in range(150)]
    texts = [(k, " ".join([*base[: k % 140], f"x{k}", *base[k % 140 + 1 :]])) for k in range(900)]
    got = dict(simhash.near_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert set(got.values()) == {0} and len(got) == 900
    assert dealt and dealt[0] <= 8


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(300))
    rows = [(5, None), (4, ""), (3, " \n"), (7, "One two"), (6, "one  TWO"), (None, "only null ids"), (None, "only null ids"), (None, long), (9, long + " more"), (9, "another text of nine"), (2, "x " * 40_000), (1, "x " * 40_000)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, _words string")
    got = sorted(simhash.near_groups(docs).collect(), key=repr)
    assert got == sorted([(5, 3), (4, 3), (3, 3), (7, 6), (6, 6), (None, None), (None, None), (None, 9), (9, 9), (9, 9), (2, 1), (1, 1)], key=repr)
    assert simhash.near_groups(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stage_drops_what_five_words_call_near(spark):
    base = [f"word{k}" for k in range(100)]
    near, far = list(base), list(base)
    near[10], near[60] = "other", "another"  # 10 of 96 shingles differ: similarity 86 / 106
    for k in range(5, 100, 20):
        far[k] = f"new{k}"  # 25 of 96 differ
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()) == [1, 3]
