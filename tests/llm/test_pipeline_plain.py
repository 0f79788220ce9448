"""The pipeline, stage by stage, against plain Python on a small corpus."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tallyloom.llm import mixing, toxicity
from tallyloom.llm.words import LETTERS, mixed

RNG = random.Random(8)
VOCABULARY = [f"w{k}" for k in range(400)] + ["été", "Über", "don't"]
INSULTS = ["idiot", "moron", "scumbag"]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    items = [(k, prose(RNG.randint(3, 30))) for k in range(12)]
    rows, labels = [], []
    for k in range(320):
        text = prose(RNG.randint(0, 90))
        if k % 8 == 0:
            text = prose(30) + " " + " ".join(RNG.choice(INSULTS) for _ in range(RNG.randint(1, 3))) + " " + prose(10)
            labels.append((k, 1))
        elif k % 8 == 1:
            labels.append((k, 0))
        elif k % 8 == 2 and k > 20:
            base = rows[k - 9][1].split()
            for _ in range(len(base) // 60 + (k % 3 == 0)):
                base[RNG.randrange(len(base))] = "changed" if base else ""
            text = " ".join(base)
        elif k % 16 == 3:
            text = prose(5) + " " + items[k % 12][1].upper() + ". " + prose(4)
        elif k % 16 == 11:
            text = rows[k - 4][1]
        rows.append((k, text if k % 50 else None, "en", f"s{k % 5}" if k % 5 else None, len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 0, y) for k, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def letters(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hashed(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(LETTERS.hashes(data, np.array([0]), np.array([len(data)]))[0])


def severity(model, text):
    """By the formulas of the model, a word at a time."""
    found = Counter()
    for word in letters(text):
        data = word.encode()
        found[hashed(word) >> 34] += 1
        for length in toxicity.BEGINNINGS:
            if len(data) > length:
                part = np.frombuffer(data[:length], np.uint8)
                h = LETTERS.hashes(part, np.array([0]), np.array([length])) + np.uint64(length)
                found[int(mixed(h)[0]) >> 34] += 1
    weights = dict(zip(model.words.tolist(), model.weights.tolist()))
    score = sum(weights.get(w, 0.0) * (1 + math.log(n)) for w, n in found.items())
    return sum(1 / (1 + math.exp(c - score)) for c in model.cuts.tolist())


def near_groups(texts):
    sets = []
    for t in texts:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    root = list(range(len(texts)))

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


def contaminated(text, items):
    words = letters(text)
    for _, item in items:
        w = letters(item)
        for window in [w[k : k + 10] for k in range(max(1, len(w) - 9))] if w else []:
            if any(words[k : k + len(window)] == window for k in range(len(words) - len(window) + 1)):
                return True
    return False


def least_capacity(sizes, shards):
    best = [0] + [10**18] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[j], sum(sizes[j:i])) for j in range(i)) for i in range(1, len(sizes) + 1)]
    return best[-1]


def test_every_stage(spark, corpus):
    folder, items = corpus
    read = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    rows = read(docs)

    kept = [r for r in rows if severity(model, r[1]) < toxicity.REJECT]
    docs = stages["toxicity"](spark, docs, folder)
    assert read(docs) == kept and 20 < len(rows) - len(kept) <= 45
    assert not any(w in (r[1] or "") for r in kept for w in INSULTS)

    worded = sorted((r for r in kept if r[1] and r[1].strip()), key=lambda r: r[0])
    groups = near_groups([r[1] for r in worded])
    once = sorted([r for r in kept if r not in worded] + [r for k, r in enumerate(worded) if groups[k] == k], key=repr)
    docs = stages["simhash near-dedup"](spark, docs, folder)
    assert read(docs) == once and len(kept) - len(once) > 30

    clean = [r for r in once if not contaminated(r[1], items)]
    docs = stages["benchmark decontamination"](spark, docs, folder)
    assert read(docs) == clean and len(once) - len(clean) >= 10

    docs = stages["mixing sources"](spark, docs, folder)
    mixed_rows = read(docs)
    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in clean}
    copies = Counter(mixed_rows)
    assert set(copies) <= set(clean) and mixed_rows == read(stages["mixing sources"](spark, spark.createDataFrame(clean[::-1], docs.schema).repartition(3), folder))
    totals = Counter()
    for r in clean:
        totals[r[3]] += size[r]
    order = sorted(s for s in totals if s is not None) + [None]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, open_sources, left = {}, set(order), float(sum(totals.values()))
    while True:
        level = left / sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if weight[s] * level > 3 * totals[s]}
        if not full:
            break
        for s in full:
            target[s], left = 3.0 * totals[s], left - 3 * totals[s]
        open_sources -= full
    target |= {s: weight[s] * level for s in open_sources}
    for s in order:
        own = [r for r in clean if r[3] == s and size[r]]
        rate = target[s] / totals[s]
        assert all(math.floor(rate + 1e-9) <= copies[r] <= math.ceil(rate - 1e-9) for r in own)
        assert abs(sum(copies[r] * size[r] for r in own) - target[s]) <= 2
    assert all(copies[r] == 1 for r in clean if not size[r])

    shards = stages["sharding"](spark, docs, folder).collect()
    by_text = {}
    for r in sorted(mixed_rows, key=lambda r: (r[0], r[1] or "")):
        by_text.setdefault(r[1], []).append(r)
    sizes = [sum(len((r[1] or "").encode()) + 1 for r in own) for own in by_text.values()]
    loads = Counter()
    for r in shards:
        loads[r.shard] += r.size
    assert len(shards) == len(mixed_rows) and max(loads.values()) == least_capacity(sizes, 8)
    text = {r[0]: r[1] for r in mixed_rows}
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in shards)
    for shard in range(8):
        assert sorted(r.slot for r in shards if r.shard == shard) == list(range(sum(r.shard == shard for r in shards)))
